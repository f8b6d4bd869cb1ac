"""Column functions over terms, triples in text, model answers and exact metrics."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

PICO = 1_000_000_000_000
#: Type of sums and of counts times PICO: twice a value of it times PICO has at most 38 digits.
WIDE = "decimal(25,0)"
#: Letters that stand for the rules where their names are hidden.
RULE_LETTERS = {"ruleA": "rdfs2", "ruleB": "rdfs3", "ruleC": "rdfs5", "ruleD": "rdfs7", "ruleE": "rdfs9", "ruleF": "rdfs11"}
#: What counts as a word. Text is first cut at blanks and underscores, so one of them, after a line's end or not, ends a run of capitals like the end of the text.
_WORDS = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|(?:\r\n|[\n\r\u0085\u2028\u2029])?[ _]|$)|\d+"


def local_name(uri: Column) -> Column:
    """What stands after the last slash; null for null or empty."""
    return F.when(uri != "", F.substring_index(uri, "/", -1))


@cache
def _decomposed() -> tuple[str, str, str, str]:
    """Of all characters but Hangul syllables, which jamo spell by arithmetic: those that fold to one or none and what they fold to, for `translate`; those that fold to several and what, one a line."""
    one, gone, several = {}, [], {}
    for code in range(128, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xAC00 + 11172:
            continue
        c = chr(code)
        to = "".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d))
        if not to:
            gone.append(c)
        elif len(to) > 1:
            several[c] = to
        elif to != c:
            one[c] = to
    return "".join(one) + "".join(gone), "".join(one.values()), "".join(several), "\n".join(several.values())


def ascii_fold(s: Column) -> Column:
    """Accents off: compatibility decompositions (NFKD) without combining marks. Marks change places among themselves only, so characters fold one by one."""
    few, few_to, many, many_to = map(F.lit, _decomposed())
    jamo = lambda first, n: F.lit("".join(map(chr, range(first, first + n))))

    def spelled(c: Column) -> Column:
        i, at = F.ascii(c) - 0xAC00, F.instr(many, c)
        syllable = F.concat(*[F.substring(jamo(first, n), k, F.lit(1)) for first, n, k in ((0x1100, 19, (i / 588).cast("int") + 1), (0x1161, 21, (i % 588 / 28).cast("int") + 1))], F.when(i % 28 > 0, F.substring(jamo(0x11A8, 27), i % 28, F.lit(1))).otherwise(""))
        return F.when(F.ascii(c) < 128, c).when(i.between(0, 11171), syllable).when(at > 0, F.element_at(F.split(many_to, "\n"), F.greatest(at, F.lit(1)))).otherwise(c)

    return F.when(s.rlike(r"^\p{ASCII}*$"), s).otherwise(F.array_join(F.transform(F.split(F.call_function("translate", s, few, few_to), ""), spelled), ""))


def split_words(s: Column, fold: bool = False) -> Column:
    return F.regexp_extract_all(ascii_fold(s) if fold else s, F.lit(_WORDS + r"|[()]"), F.lit(0))


def _spelled(words: Column, by: str) -> Column:
    """Words of ASCII letters, digits or brackets with a capital each. No lambda over them, so that it is compiled with what stands around it."""
    return F.replace(F.initcap(F.array_join(words, " ")), F.lit(" "), F.lit(by))


def _plain_words(s: Column, fold: bool) -> Column:
    """split_words without the brackets."""
    return F.regexp_extract_all(ascii_fold(s) if fold else s, F.lit(_WORDS), F.lit(0))


def class_name(s: Column, fold: bool = False) -> Column:
    return _spelled(_plain_words(s, fold), "")


def property_name(s: Column, fold: bool = False) -> Column:
    words = _plain_words(s, fold)
    name, first = _spelled(words, ""), F.length(F.coalesce(F.get(words, F.lit(0)), F.lit("")))
    return F.concat(F.lower(F.substring(name, F.lit(1), first)), F.substring(name, first + 1, F.length(name)))


def instance_name(s: Column, fold: bool = False) -> Column:
    return _spelled(split_words(s, fold), "_")


WIKIDATA = "http://www.wikidata.org/entity/"


def property_of(uri: Column, label: Column, fold: bool = True) -> Column:
    """A property's name: of an opaque Wikidata entity that of its label, of any other its local name."""
    return F.when(uri.startswith(WIKIDATA), property_name(label, fold)).otherwise(local_name(uri))


def slot_kind(slot: str) -> str:
    return "instance" if slot in "ab" else "property" if slot in "ijk" else "class"


def as_kind(term: Column, slot: str) -> Column:
    """The term in the spelling of the slot that it has come to."""
    return {"instance": instance_name, "property": property_name, "class": class_name}[slot_kind(slot)](term)


def deranged(values: list[Column]) -> Column:
    """An array of the values with each place changed by value: the first rotation that does it, else the first permutation by index, else null."""
    n = len(values)
    if n < 2:
        return F.lit(None).cast("array<string>")
    tries = [F.when(_all([values[i] != values[(i + k) % n] for i in range(n)]), F.array(*[values[(i + k) % n] for i in range(n)])) for k in range(1, n)]
    # up to four values a rotation exists if anything does
    return F.coalesce(*tries, *([_any_derangement(F.array(*values), n)] if n > 4 else []))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _any_derangement(v: Column, n: int) -> Column:
    """Place by place the first index whose value differs and leaves a way to fill the places after it: there is one while no value has more uses left than places that are not its own."""
    at = F.sequence(F.lit(0), F.lit(n - 1))
    count = lambda keep: F.size(F.filter(at, keep))

    def fits(used: Column, i: Column, j: Column) -> Column:
        over = lambda x: count(lambda k: ~F.array_contains(used, k) & (k != j) & (v[k] == x)) + count(lambda k: (k > i) & (v[k] == x)) > n - 1 - i
        return ~F.array_contains(used, j) & (v[j] != v[i]) & ~F.exists(v, over)

    step = lambda used, i: F.concat(used, F.slice(F.filter(at, lambda j: fits(used, i, j)), 1, 1))
    order = F.aggregate(at, F.array().cast("array<int>"), step)
    return F.when(~F.exists(v, lambda x: x.isNull()) & (F.size(order) == n), F.transform(order, lambda j: v[j]))


# --- triples in text ---


def candidates(text: Column) -> Column:
    """All `<...>` runs in order, with blanks at the brackets and double quotes removed and outer brackets stripped."""
    clean = lambda c: F.replace(F.replace(F.replace(c, F.lit("< "), F.lit("<")), F.lit(" >"), F.lit(">")), F.lit('"'), F.lit(""))
    return F.transform(F.regexp_extract_all(text, F.lit("<[^>]+>"), F.lit(0)), lambda c: F.btrim(clean(c), F.lit("<>")))


def triple_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(candidates(text)))


def triple_parts(t: Column) -> Column:
    """struct(s, p, o); the object keeps further commas; null with fewer than three parts."""
    f = F.split(t, ", ", 3)
    return F.when(F.size(f) == 3, F.struct(f[0].alias("s"), f[1].alias("p"), f[2].alias("o")))


_SPACE = r"[\s\x1c-\x1f]"


def stripped(s: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(s, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def strict_triples(text: Column) -> Column:
    """Audit form: exactly three parts between ", ", each stripped; others are left out. A comma without a blank is part of a name."""
    cut = F.filter(F.transform(F.regexp_extract_all(text, F.lit("<([^>]+)>"), F.lit(1)), lambda c: F.split(c, ", ")), lambda f: F.size(f) == 3)
    parts = lambda end: F.transform(cut, lambda f: F.struct(end(f[0]).alias("s"), end(f[1]).alias("p"), end(f[2]).alias("o")))
    # visible ASCII with single blanks, none at a part's end: nothing to strip
    return F.when(text.rlike(r"[^\x20-\x7E]|  | [>,]|< "), parts(stripped)).otherwise(parts(lambda c: c))


def flexible(candidate: Column, triple: Column, normal: Column | None = None) -> Column:
    """Whether the candidate is the triple's three terms in order, between commas or white space.

    Where no term holds a comma or white space, that is so exactly if both have one normal form (normal: the candidate's, if
    known); a pattern is built for the other triples alone.
    """
    quote = lambda t: F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    p = triple_parts(triple)
    gap = F.lit(f"(?:,|{_SPACE})+")
    pattern = F.concat(F.lit(rf"(?U)\A{_SPACE}*"), quote(p["s"]), gap, quote(p["p"]), gap, quote(p["o"]), F.lit(rf"{_SPACE}*\z"))
    plain = F.lit(rf"(?U)^[^,\s\x1c-\x1f]+, [^,\s\x1c-\x1f]+, [^,\s\x1c-\x1f]+$")
    return F.when(F.rlike(triple, plain), (normal_candidate(candidate) if normal is None else normal) == F.replace(triple, F.lit(","), F.lit(""))).otherwise(F.rlike(candidate, pattern))


def normal_candidate(c: Column) -> Column:
    return F.regexp_replace(stripped(c), rf"(?U)(?:,|{_SPACE})+", " ")


def used_rules(text: Column) -> Column:
    """Rules of the first [used_rules: ...], letters replaced by names, an empty place as ""; no rules without one."""
    inner = F.regexp_extract(text, r"(?U)\[used_rules:\s*([^\]]+)\]", 1)
    letters = F.create_map(*[F.lit(x) for kv in RULE_LETTERS.items() for x in kv])
    rules = F.transform(F.split(inner, ","), lambda r: F.coalesce(letters[stripped(r)], stripped(r)))
    return F.when(inner != "", rules).otherwise(F.array().cast("array<string>"))


def answer_text(raw: Column) -> Column:
    """The answer of a response row of any of three shapes; "" where the last is not a string."""
    v = F.try_parse_json(raw)
    get = lambda p: F.try_variant_get(v, p, "string")
    plain = F.when(F.schema_of_variant(F.try_variant_get(v, "$.response", "variant")) == "STRING", get("$.response"))
    return F.coalesce(get("$.response.body.choices[0].message.content"), get("$.choices[0].message.content"), plain, F.lit(""))


def request_id(raw: Column) -> Column:
    v = F.try_parse_json(raw)
    some = lambda p: F.nullif(F.try_variant_get(v, p, "string"), F.lit(""))
    return F.coalesce(some("$.custom_id"), some("$.id"), F.lit(""))


# --- exact metrics: whole numbers of 1e-12, rounded half up ---


def ratio(n: Column, d: Column) -> Column:
    """n / d in units of 1e-12; 0 where d is 0."""
    n, d = n.cast("long"), d.cast("long")
    return F.when(d == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", 2 * n * F.lit(PICO) + d, 2 * F.when(d == 0, 1).otherwise(d)))


def share(n: Column, d: Column) -> Column:
    """`ratio` of counts over many rows: from 4.6 million on, n in units of 5e-13 is no long any more."""
    n, d = n.cast(WIDE), d.cast(WIDE)
    return F.when(d == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", 2 * n * F.lit(PICO) + d, 2 * F.when(d == 0, 1).otherwise(d)))


def mean(total: Column, k: Column) -> Column:
    """The mean of k values of 1e-12, half up; null for none. total: from `total_of`."""
    total, k = total.cast(WIDE), k.cast(WIDE)
    return F.when(k > 0, F.call_function("div", 2 * total + k, 2 * F.when(k > 0, k)))


def total_of(values: Column) -> Column:
    """The sum of whole values, as a decimal: of over 9.2 million values of 1 in units of 1e-12 it is no long any more. Millions and the rest are summed as longs."""
    return F.sum(F.call_function("div", values, F.lit(10**6))).cast(WIDE) * F.lit(10**6) + F.sum(values % F.lit(10**6))


def metric_text(pico: Column) -> Column:
    """Twelve places without closing zeros; "" where missing."""
    whole, rest = F.call_function("div", pico, F.lit(PICO)), F.lpad(F.pmod(pico, F.lit(PICO)).cast("string"), 12, "0")
    return F.when(pico.isNull(), "").otherwise(F.regexp_replace(F.concat(whole.cast("string"), F.lit("."), rest), r"\.?0+$", ""))


def query_hash(q: Column) -> Column:
    return F.substring(F.md5(F.regexp_replace(q, r"^\s+|\s+$", "").cast("binary")), 1, 8)


def tokens_estimated(s: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(s) / 4)).cast("long")


# --- rules, identifiers, addresses ---


def expanded_rules(pattern: Column) -> Column:
    """Rules of a pattern: rdfs2_3 is rdfs2 and rdfs3; what is no pattern stands for itself."""
    parts = F.transform(F.split(F.regexp_replace(pattern, "^rdfs", ""), "_"), lambda n: F.concat(F.lit("rdfs"), n))
    return F.when(pattern.rlike(r"^rdfs\d+(_\d+)*$"), parts).otherwise(F.array(pattern))


def rule_order(pattern: Column) -> Column:
    """Sort key: number of rules, then the rules by number, so that rdfs9 stands before rdfs11."""
    numbers = F.transform(F.regexp_extract_all(pattern, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int"))
    return F.struct(F.size(numbers).alias("n"), numbers.alias("rules"), pattern.alias("pattern"))


def uid(letter: str, *content: Column) -> Column:
    """The letter, a hyphen and eight hex digits: of the content's hash, so that a rerun gives the same; without content random ones."""
    digits = F.sha2(F.concat_ws("\x1f", *content), 256) if content else F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat(F.lit(f"{letter}-"), F.substring(digits, 1, 8))


RESOURCE = "http://dbpedia.org/resource/"


def unwrapped(uri: Column) -> Column:
    """A resource whose local part is itself a resource's IRI, once or more, as that resource."""
    return F.when(~uri.startswith(RESOURCE * 2), uri).otherwise(F.regexp_replace(uri, rf"^(?:{RESOURCE})+(?={RESOURCE})", ""))


def url_encoded(name: Column) -> Column:
    """Percent-encoded UTF-8; letters, digits and _()-,.'!*~ stay."""
    out = F.url_encode(name)
    for code, char in (("+", "%20"), ("%28", "("), ("%29", ")"), ("%2C", ","), ("%27", "'"), ("%21", "!"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def entity_number(uri: Column) -> Column:
    """Q and its number of a Wikidata entity's IRI, else null."""
    return F.when(uri.startswith(WIKIDATA), F.nullif(F.regexp_extract(uri, f"^{WIKIDATA}(Q[1-9][0-9]*)$", 1), F.lit("")))


def path_safe(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_")


def source_name(source: Column, endpoints: Column) -> Column:
    """A sample's source as named, else by its first endpoint."""
    first = F.get(endpoints, F.lit(0))
    known = F.coalesce(*[F.when(F.contains(first, F.lit(part)), F.lit(short)) for part, short in (("wikidata", "wdt"), ("dbpedia", "dbp"), ("lov", "lov"))])
    return F.coalesce(source, known, F.lit("unknown"))


def utc_text(seconds: Column) -> Column:
    """YYYYMMDDHHMMSS of seconds since 1970, in UTC whatever the session's zone."""
    day, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    clock = F.lpad((F.floor(rest / 3600) * 10000 + F.floor(F.pmod(rest, F.lit(3600)) / 60) * 100 + F.pmod(rest, F.lit(60))).cast("long").cast("string"), 6, "0")
    return F.concat(F.date_format(F.date_from_unix_date(day.cast("int")), "yyyyMMdd"), clock)


def duration_text(seconds: Column) -> Column:
    whole = lambda c: F.floor(c).cast("long").cast("string")
    short = F.format_string("%.1fs", seconds)
    minutes = F.concat(whole(seconds / 60), F.lit("m"), whole(F.pmod(seconds, F.lit(60.0))), F.lit("s"))
    hours = F.concat(whole(seconds / 3600), F.lit("h"), whole(F.pmod(seconds, F.lit(3600.0)) / 60), F.lit("m"), whole(F.pmod(seconds, F.lit(60.0))), F.lit("s"))
    return F.when(seconds < 60, short).when(seconds < 3600, minutes).otherwise(hours)


# --- JSON of requests and responses ---


def json_at(value: Column, path: str) -> Column:
    """The variant at a dotted path of keys and list places: null where it is missing, a JSON null where that stands there."""
    for part in path.split("."):
        inner = F.try_variant_get(value, "$['" + part.replace("'", "\\'") + "']", "variant")
        value = F.coalesce(inner, F.try_variant_get(value, f"$[{part}]", "variant")) if part.isdecimal() else inner
    return value


def response_fields(raw: Column, fields: dict[str, str]) -> Column:
    """JSON of the configured fields (name -> dotted path) that a response has: missing ones are left out, null and nested ones kept."""
    v = F.try_parse_json(raw)
    quoted = lambda name: '"' + name.replace("\\", "\\\\").replace('"', '\\"') + '":'
    parts = [F.when(json_at(v, path).isNotNull(), F.concat(F.lit(quoted(name)), F.to_json(json_at(v, path)))) for name, path in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def input_text(raw: Column) -> Column:
    """What a request line sends: a batch line's message contents by lines, else its system text, if any, and its input."""
    v = F.try_parse_json(raw)
    get = lambda p: F.try_variant_get(v, p, "string")
    contents = F.transform(F.try_variant_get(v, "$.body.messages", "array<variant>"), lambda m: F.coalesce(F.try_variant_get(m, "$.content", "string"), F.lit("")))
    single = F.concat_ws("\n", F.nullif(get("$.system"), F.lit("")), F.coalesce(get("$.input"), F.lit("")))
    return F.when(F.try_variant_get(v, "$.body", "variant").isNotNull(), F.coalesce(F.array_join(contents, "\n"), F.lit(""))).otherwise(single)


def expected_text(expected: Column, condition: Column, pattern: Column) -> Column:
    """The answer that is asked for: the expected triples and, under ARP, the used rules, by letters under ARP-def."""
    letter = F.create_map(*[F.lit(x) for short, rule in RULE_LETTERS.items() for x in (rule, short)])
    rules = F.transform(F.regexp_extract_all(pattern, F.lit(r"\d+"), F.lit(0)), lambda n: F.concat(F.lit("rdfs"), n))
    shown = F.when(condition == "ARP-def", F.transform(rules, lambda r: F.coalesce(letter[r], r))).otherwise(rules)
    used = F.concat(F.lit("[used_rules: "), F.array_join(shown, ", "), F.lit("]"))
    out = F.coalesce(expected, F.lit(""))
    return F.when(~condition.startswith("ARP-"), out).when(out == "", used).otherwise(F.concat(out, F.lit("\n"), used))


# --- reasons ---


def sameas_error(*reasons: Column) -> Column:
    """Different reasons that are failed identity queries, in order; null without one."""
    kept = F.array_distinct(F.filter(F.array(*reasons), lambda r: F.coalesce(r.startswith("sameAs query error"), F.lit(False))))
    return F.when(F.size(kept) > 0, F.array_join(kept, "; "))


def unresolved_reason(s_ids: Column, s_reason: Column, o_ids: Column, o_reason: Column) -> Column:
    """Which ends of a triple have no identity, and why; null if both have one."""
    part = lambda end, ids, why: F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, F.concat(F.lit(f"{end}="), F.coalesce(F.nullif(why, F.lit("")), F.lit("unresolved"))))
    return F.nullif(F.concat_ws("; ", part("s", s_ids, s_reason), part("o", o_ids, o_reason)), F.lit(""))
