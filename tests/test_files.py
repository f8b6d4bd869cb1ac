"""Sources, sinks, runs and reports that go through files or a client."""

import json

import pytest
from pyspark.sql import functions as F

from tripleforge.operators import evaluate, reports, runners
from tripleforge.sources import linked, names, relations, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_names(spark):
    got = one(spark, names.eval_name(F.lit("eval-flex__m-1__ARP-full__rk__rdfs9_11__n400__b-0123abcd")))
    assert got.asDict() == {"model": "m-1", "prompting_condition": "ARP-full", "dataset_variant": "rk", "pattern_id": "rdfs9_11", "presented_rule_type": "ARP", "rule_format": "full", "rules": "rdfs9,rdfs11", "n_rule": 2}
    assert one(spark, names.eval_name(F.lit("eval__m__c__v"))) is None and one(spark, names.eval_name(F.lit("task__a__b__c__d"))) is None
    key = lambda s: one(spark, names.task_key(F.lit(s)))
    assert key("response__m__c__v__p__n1__b-01234567__batch_ab12__20260101010101") == key("response__m__c__v__p__n1__b-01234567__0123456789abcdef") == "c__v__p__n1__b-01234567"
    assert key("response__m__c__v__20260101010101__20260101010102") == "c__v__20260101010101"
    assert one(spark, names.task_name(F.lit("task__c__v__p__n1"))).pattern_id == "p" and one(spark, names.response_name(F.lit("response__m__c__v"))) is None
    assert one(spark, names.request_name(F.lit("seq__m__c__v__p"))).model == one(spark, names.request_name(F.lit("batch__m__c__v__p"))).model == "m"
    got = one(spark, names.dataset_name(F.lit("data/gs/2-rule/dataset__gs__rdfs2_3__n400__f-0a1b__b-00ff.json"), "gs"))
    assert (got.n, got.fetch_uid, got.build_uid, got.rule_dir, got.out_name) == (400, "f-0a1b", "b-00ff", "2-rule", "validation__gs__rdfs2_3__n400__f-0a1b__b-00ff.json")
    assert one(spark, names.stem(F.lit("a/b.c/d__e.jsonl"))) == "d__e"


def test_readers_and_configurations(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "response__m__c.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}\r\n{"a": 3}', encoding="utf-8")
    (tmp_path / "other.txt").write_text("x", encoding="utf-8")
    got = [(r.pos, r.value) for r in relations.jsonl(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [(0, '{"a": 1}'), (3, '{"a": 2}'), (4, '{"a": 3}')]  # blank lines count
    (tmp_path / "s.json").write_text(json.dumps({"metadata": {"pattern_id": "rdfs2", "count": 2}, "entries": [{"a": "1", "b": "2"}, {"a": "3", "b": None}]}))
    got = relations.sample_of(spark, str(tmp_path), {"rdfs2": "s.json"}, "rdfs2").orderBy("pos").collect()
    assert [(r.pos, r.a, r.b, r.pattern_id) for r in got] == [(0, "1", "2", "rdfs2"), (1, "3", None, "rdfs2")]
    for files in ({}, {"rdfs2": "none.json"}):
        with pytest.raises(FileNotFoundError):
            relations.sample_of(spark, str(tmp_path), files, "rdfs2")
    config = {"a": {"runner": "openai-batch"}, "b": {"runner": "sequential-x"}, "c": {}}
    assert list(relations.runner_models(config, "openai-batch", True)) == ["a"] and list(relations.runner_models(config, "sequential", False)) == ["b"]
    assert [tuple(r) for r in relations.prices(spark, {"_note": {}, "m": {"input_per_1m": 1, "output_per_1m": 2.5}}).collect()] == [("m", 1.0, 2.5)]
    assert relations.validation_files({"p": "x", "q": "y"}, [" q "]) == [("q", "y")]
    with pytest.raises(ValueError):
        relations.validation_files({"p": "x"}, ["z"])
    (tmp_path / "t.nt").write_text('<http://x/s> <http://x/p> <http://x/o> .\n<http://x/s> <http://x/p> "text" .\n# <a> <b> <c>\n')
    assert [tuple(r) for r in relations.ntriples(spark, str(tmp_path / "t.nt")).collect()] == [("http://x/s", "http://x/p", "http://x/o")]
    b = spark.createDataFrame([({"a": ("1",), "b": ("2",)},), ({"a": ("3",)},), ({"a": ("5",), "b": ("5",)},)], "binding map<string,struct<value:string>>")
    assert [tuple(r) for r in relations.bindings(b, ["a", "b"], F.col("a") != F.col("b")).collect()] == [("1", "2")]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("rdfs2", i, f"p{i}", "e") for i in range(3)], "pattern_id string, pos int, premise_knowledge string, expected_output string")
    name = sinks.dataset_name(F.lit("rk"), F.col("pattern_id"), F.lit(3), F.lit(""), F.lit("b-00000001"))
    docs = sinks.documents(rows, name, "pos", ["premise_knowledge", "expected_output"], {"pattern_id": F.col("pattern_id")})
    got = docs.first()
    assert got.name == "dataset__rk__rdfs2__n3__b-00000001"
    assert json.loads(got.value) == {"metadata": {"pattern_id": "rdfs2", "count": 3}, "entries": [{"premise_knowledge": f"p{i}", "expected_output": "e"} for i in range(3)]}
    at = tmp_path / "out"
    sinks.write(docs, str(at), extension=".json")
    sinks.write(docs.withColumn("value", F.lit("new")), str(at), extension=".json")  # what is there stays
    assert [f.name for f in at.glob("[!._]*")] == [got.name + ".json"] and json.loads((at / f"{got.name}.json").read_text())["metadata"]["count"] == 3
    two = spark.createDataFrame([("other = a b", "x"), (got.name, "skipped")], "name string, value string")
    sinks.write(two, str(at), extension=".json")
    sinks.write(docs.withColumn("value", F.lit("new")), str(at), overwrite=True, extension=".json")  # only the names that are written
    assert {f.name: f.read_text() for f in at.glob("[!._]*")} == {got.name + ".json": "new\n", "other = a b.json": "x\n"}
    with pytest.raises(Exception, match="no name of a file"):
        sinks.write(two.unionByName(spark.createDataFrame([("a/b", "x"), ("c", "x")], "name string, value string")), str(at), overwrite=True)
    assert sorted(f.name for f in at.iterdir() if not f.name.startswith(".")) == sorted([got.name + ".json", "other = a b.json"])  # a failed write leaves nothing
    many = sinks.lines(rows, F.lit("f"), F.col("premise_knowledge"), "pos")
    sinks.write(many, str(tmp_path / "lines"), extension=".jsonl")
    assert (tmp_path / "lines" / "f.jsonl").read_text() == "p0\np1\np2\n"
    scores = spark.createDataFrame([("m2", "NRP-full", "rk", "rdfs11", 1, 2, 1, 500_000_000_000, None), ("m1", "NRP-full", "rk", "rdfs11", 1, 2, 1, 333_333_333_333, 10**12), ("m1", "NRP-full", "rk", "rdfs9", 1, 2, 1, 0, None)], "model string, prompting_condition string, dataset_variant string, pattern_id string, n_rule long, n_total long, n_correct long, f1_triple long, f1_rule long")
    sinks.write_csv(scores, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text[0].split(",") == list(sinks.COLUMNS) and [x.split(",")[5] for x in text[1:]] == ["rdfs9", "rdfs11", "rdfs11"] and "0.333333333333" in text[2]
    back = {(r.model, r.pattern_id): (r.f1_triple, r.f1_rule, r.n_total) for r in relations.scores(spark, str(tmp_path / "csv")).collect()}
    assert back == {("m1", "rdfs9"): (0, None, 2), ("m1", "rdfs11"): (333_333_333_333, 10**12, 2), ("m2", "rdfs11"): (500_000_000_000, None, 2)}
    with pytest.raises(FileExistsError):
        sinks.write_csv(scores, str(tmp_path / "csv"))
    sinks.write_by_model(scores, str(tmp_path / "models"))
    assert sorted(p.name for p in (tmp_path / "models").glob("model=*")) == ["model=m1", "model=m2"]
    assert sinks.view(scores.select("model", "f1_triple", "f1_rule"), ["model", "f1_triple"], {"f1_rule": "/"})[1:] == [["m1", "0.000", "/"], ["m1", "0.333", "1.000"], ["m2", "0.500", "/"]]
    req, resp = (spark.createDataFrame([(s,) for s in x], "stem string") for x in (["seq__m__c__v__p", "seq__m__c__v__q"], ["response__m__c__v__p__2026", "response__m__c__v__qq__2026"]))
    assert [r.stem for r in sinks.without_response(req, resp).collect()] == ["seq__m__c__v__q"]
    assert sinks.unwritten(rows, rows.where("pos > 0"), ["pos"]).count() == 1


def test_responses_to_rows(spark, tmp_path):
    task = {"metadata": {"prompting_condition": "ARP-full", "dataset_variant": "rk", "pattern_id": "rdfs9", "rules": ["rdfs9"]}, "tasks": [{"task_id": f"request-{i}", "premise_knowledge": "<X, rdfs:subClassOf, Y>, <a, rdf:type, X>", "expected_output": "<a, rdf:type, Y>"} for i in (1, 2)]}
    (tmp_path / "t").mkdir()
    (tmp_path / "r").mkdir()
    (tmp_path / "t" / "task__ARP-full__rk__rdfs9__n2__b-01234567.json").write_text(json.dumps(task))
    line = lambda i, text: json.dumps({"custom_id": f"request-{i}", "response": {"body": {"choices": [{"message": {"content": text}}]}}})
    stem = "response__m__ARP-full__rk__rdfs9__n2__b-01234567"
    (tmp_path / "r" / f"{stem}__batch_ab.jsonl").write_text(line(1, "<a, rdf:type, Y> [used_rules: rdfs9]") + "\n\n" + line(2, "<a rdf:type Y> [used_rules: rdfs2]"))
    (tmp_path / "r" / f"{stem}__batch_cd.jsonl").write_text(line(3, "<a, rdf:type, Y>"))  # an id without a task
    (tmp_path / "r" / "response__m__ARP-full__rk__rdfs2__n2.jsonl").write_text(line(1, ""))
    responses, tasks = evaluate.read_responses(spark, str(tmp_path / "r")), evaluate.read_tasks(spark, str(tmp_path / "t"))
    rows, lost = evaluate.paired(responses, tasks)
    for mode, ok in (("strict", [True, False]), ("flex", [True, True])):
        done = evaluate.scored(rows, mode)
        status = {r.file.rsplit("/", 1)[1]: r.status for r in evaluate.outcome(done, lost).collect()}
        assert status == {f"{stem}__batch_ab.jsonl": "written", f"{stem}__batch_cd.jsonl": "error", "response__m__ARP-full__rk__rdfs2__n2.jsonl": "no_task"}
        kept = evaluate.written(done, evaluate.outcome(done, lost)).orderBy("task_id").collect()
        assert [r.triple_ok for r in kept] == ok and [r.overall_ok for r in kept] == [True, False] and kept[1].model_rules == ["rdfs2"]
        assert evaluate.outcome(done, lost, there=done.where("task_id = 'request-1'")).where("status = 'skipped_exists'").count() == 1
    with pytest.raises(Exception, match="empty target"):
        reports.checked_targets(evaluate.scored(rows)).collect()


GOOD = {"p": {"base_url": " http://x ", "api_key_env": "KEY", "response_fields": {"response": "choices.0.message.content", "why": "choices.0.finish", "use": "usage"}}}


@pytest.mark.parametrize("name, change", [("q", {}), ("p", {"base_url": " "}), ("p", {"api_key_env": None}), ("p", {"response_fields": {"other": "a"}}), ("p", {"response_fields": {"response": "a", "": "b"}}), ("p", {"response_fields": {"response": "a", "id": "b"}}), ("p", {"response_fields": {"response": "a..b"}}), ("p", {"extra_body": []}), ("p", {"extra_body": {"model": "m"}}), ("p", {"response_fields": None})])
def test_providers_are_checked(name, change):
    with pytest.raises(ValueError):
        runners.provider({"p": GOOD["p"] | change}, name)


def test_providers():
    own = runners.provider(GOOD, "p")
    assert own["base_url"] == "http://x" and own["extra_body"] == {}
    assert runners.api_key(own, {"KEY": " k "}) == "k"
    for bad in ([], {"p": 1}):
        with pytest.raises(ValueError):
            runners.provider(bad, "p")
    with pytest.raises(ValueError):
        runners.api_key(own, {"KEY": " "})
    payload = {"choices": [{"message": {"content": "hi"}, "finish": None}], "usage": {"n": 1}}
    with pytest.raises(ValueError, match="base_url .*; response_fields "):  # all that is amiss at once
        runners.provider({"p": {"api_key_env": "KEY"}}, "p")


def test_attempts():
    waits, answers = [], iter([("", {"n": 1}), RuntimeError("down"), ("yes", {"n": 3})])

    def send():
        got = next(answers)
        if isinstance(got, Exception):
            raise got
        return got

    got = runners.answered(send, sleep=waits.append)
    assert (got["content"], got["n_tries"], got["attempts"], got["error"]) == ("yes", 3, [{"n": 1}, {"n": 3}], None) and waits == [2.0, 4.0]
    got = runners.answered(lambda: (None, {}), tries=2, sleep=waits.append)
    assert got["content"] is None and got["error"] == "empty content" and got["n_tries"] == 2
    asks = iter([False, "part", True])
    assert runners.asked(lambda: next(asks), usable=lambda x: x != "part", confirm=2, sleep=waits.append) == (True, None)
    assert runners.asked(lambda: False, confirm=2, sleep=waits.append) == (False, None)
    assert runners.asked(lambda: 1 / 0, final=lambda e: True)[1].startswith("ZeroDivisionError")
    assert runners.asked(lambda: "part", usable=lambda x: False, tries=3, sleep=waits.append) == (None, "partial result")


def test_run(spark):
    def client():
        return lambda r: (None if r["id"] == "2" else "re " + r["input"], {"choices": [{"finish": None}], "id": r["id"]})

    rows = spark.createDataFrame([("1", "m", "a", None), ("2", "m", "b", "s")], "id string, model string, input string, system string")
    got = {r.id: r for r in runners.run(rows, client, {"response": "id", "why": "choices.0.finish", "no": "x"}, tries=2, sleep=lambda s: None).collect()}
    assert got["1"].response == "re a" and json.loads(got["1"].fields) == {"why": None} and got["1"].attempts == [] and got["1"].error is None
    assert got["2"].response is None and got["2"].error == "empty content" and len(got["2"].attempts) == 2
    assert runners.run(rows, client, tries=1, sleep=lambda s: None).where("id = '1' AND raw_response IS NULL").count() == 1


def test_batches(spark):
    manifest = spark.createDataFrame([(f"batch__m__{i}", f"b{i}") for i in range(6)], "key string, batch_id string")
    states = spark.createDataFrame([("b0", "in_progress", None, None), ("b1", "failed", None, None), ("b2", "odd", None, None), ("b3", "completed", None, 5), ("b4", "completed", "f", 86_399), ("b5", "completed", "f", 951_782_400)], "batch_id string, status string, output_file_id string, completed_at long")
    there = spark.createDataFrame([("response__m__4__b4__19700101235959",)], "out_name string")
    got = runners.polled(manifest, states, there)
    assert {r.batch_id: r.outcome for r in got.collect()} == {"b0": "pending", "b1": "failed", "b2": "error", "b3": "error", "b4": "skipped_exists", "b5": "completed"}
    assert got.where("batch_id = 'b5'").first().out_name == "response__m__5__b5__20000229000000"
    assert {r.batch_id for r in runners.remaining(got).collect()} == {"b0", "b2", "b3"}
    assert runners.uploaded(spark.createDataFrame([("batch__m__0", "x"), ("new", "y")], "key string, file string"), manifest).first().key == "new"


def test_run_goes_on(spark, tmp_path):
    """A run that breaks off in the middle: what was answered is in the log and is not sent again."""
    rows = spark.createDataFrame([(str(i), "m", f"x{i}", None) for i in range(20)], "id string, model string, input string, system string").coalesce(1)
    sent = tmp_path / "sent"

    def client(breaks):
        def send(r):
            if breaks and r["id"] == "12":
                raise SystemExit("killed")  # not an attempt that failed: the task ends
            with open(sent, "a") as f:
                f.write(r["id"] + "\n")
            return ("" if breaks and r["id"] == "3" else "re " + r["input"]), {"a": [r["id"]]}

        return lambda: send

    log, paths = "file://" + str(tmp_path / "log"), {"response": "x", "first": "a.0"}
    with pytest.raises(Exception, match="killed|SystemExit|exited"):
        runners.resumed(rows, client(True), log, paths, tries=1, sleep=lambda s: None)
    before = sent.read_text().split()
    assert 0 < len(before) < 20
    (tmp_path / "log" / "cut.jsonl").write_text('{"id": "19", "resp')
    got = {r.id: r for r in runners.resumed(rows.union(rows), client(False), log, paths, tries=1).collect()}
    assert len(got) == 20 and all(r.response == f"re x{i}" and json.loads(r.fields) == {"first": i} for i, r in got.items())
    counts = {i: sent.read_text().split().count(i) for i in got}
    assert {i for i, n in counts.items() if n > 1} == ({"3"} if "3" in before else set())
    assert got["1"].n_sent == 1 and runners.resumed(rows, client(True), log, paths).count() == 20 and len(sent.read_text().split()) == sum(counts.values())


def test_live_source(spark):
    """Ranges and pages give each binding once; a server that only breaks off is an error, not a shorter table."""
    from tripleforge.sources.live import live_source

    table = [{"s": {"value": f"k{i:03d}"}} | ({"o": {"value": str(i)}} if i % 3 else {}) for i in range(250)]

    def client(breaks):
        def made():
            asks = {}

            def ask(low, high, after):
                n = asks[after] = asks.get(after, 0) + 1
                rows = [r for r in table if (low is None or r["s"]["value"] >= low) and (high is None or r["s"]["value"] < high) and (after is None or r["s"]["value"] > after)]
                if n == 1 and len(rows) % 2:
                    raise OSError("down")
                return {"rows": rows[: 20 if n > 2 else 3], "complete": n > 2 and not (breaks and after == "k119")}

            return ask

        return made

    for name, breaks in (("live_whole", False), ("live_broken", True)):
        spark.dataSource.register(live_source(name, "s string, o string", client(breaks), "s", tries=5, wait=0.0))
    read = lambda name, **o: spark.read.format(name).options(**o).load()
    whole = read("live_whole", bounds='["k100", "k101", "k200"]')
    assert whole.rdd.getNumPartitions() == 4
    assert sorted((r.s, r.o) for r in whole.collect()) == [(f"k{i:03d}", str(i) if i % 3 else None) for i in range(250)]
    assert sorted(r.s for r in read("live_whole", **{"from": "k010", "until": "k013"}).collect()) == ["k010", "k011", "k012"]
    assert read("live_whole", **{"from": "x"}).count() == 0
    with pytest.raises(Exception, match="partial result"):
        read("live_broken", bounds='["k100"]').collect()
    with pytest.raises(Exception, match="not in order"):
        read("live_whole", bounds='["k2", "k1"]').collect()


def test_batch_events_and_downloads(spark, tmp_path):
    kind = "batch_id string, at long, status string, output_file_id string, completed_at long"
    events = spark.createDataFrame([("b1", 3, "in_progress", None, None), ("b1", 2, "completed", "f1", 60), ("b2", 1, "validating", None, None), ("b2", 4, "cancelling", None, None), ("b3", 1, "expired", None, None), ("b3", 9, "in_progress", None, None)], kind)
    states = runners.folded(events.union(events.orderBy("at")))
    assert {r.batch_id: r.status for r in states.collect()} == {"b1": "completed", "b2": "cancelling", "b3": "expired"}
    manifest = spark.createDataFrame([("batch__m__1", "b1"), ("batch__m__2", "b2"), ("batch__m__3", "b3")], "key string, batch_id string")
    got = runners.polled(manifest, states, spark.createDataFrame([], "out_name string"))
    sinks.write(runners.downloaded(got, lambda: lambda f: (f"{f} {n}\r\n" for n in range(10_001))), str(tmp_path / "out"), extension=".jsonl")
    (file,) = (tmp_path / "out").glob("*.jsonl")
    assert file.name == "response__m__1__b1__19700101000100.jsonl" and file.read_text().splitlines() == [f"f1 {n}" for n in range(10_001)]

    def broken():
        def fetch(f):
            yield "first"
            raise OSError("cut off")

        return fetch

    with pytest.raises(Exception, match="cut off"):
        sinks.write(runners.downloaded(got, broken), str(tmp_path / "none"), extension=".jsonl")
    assert not list((tmp_path / "none").glob("*.jsonl"))


def test_line_places_of_files_in_blocks(spark, tmp_path):
    """Files of many blocks and all kinds of line ends give the places that reading them whole gives."""
    import random

    draw = random.Random(7)
    for n in range(4):
        (tmp_path / f"f{n}.jsonl").write_bytes("".join(draw.choice(["", "  ", "x" * draw.randrange(1, 200), "\u00e9" * draw.randrange(1, 40)]) + draw.choice(["\n", "\r\n"]) for _ in range(draw.choice([0, 3, 400]) if n else 400)).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = relations.jsonl(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = sorted((r.file.rsplit("/", 1)[1], r.pos, r.value) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(f.name, n, x.removesuffix("\n")) for f in tmp_path.glob("*.jsonl") for n, x in enumerate(f.open(encoding="utf-8")) if x.strip(" \n")]
    assert got == sorted(want)


def test_numbered(spark):
    from tripleforge.operators.sampling import numbered

    rows = spark.range(0, 3000, 1, 7).selectExpr("(id * 7919) % 3001 AS k", "id AS place_of")
    got = numbered(rows, F.desc("k")).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 3001)) and [r.k for r in got] == sorted((r.k for r in got), reverse=True)
    assert numbered(rows.where("false"), "k").count() == 0


def test_subproperty_chains(spark):
    wd = "http://www.wikidata.org/entity/"
    h = spark.createDataFrame([(0, wd + "P1", "one", wd + "P2", "two"), (1, wd + "P2", "two", wd + "P3", "three"), (2, wd + "P2", "two", wd + "P2", "two"), (3, wd + "P4", "", wd + "P2", "two"), (4, wd + "P5", "own", wd + "P3", "three")], "pos int, child string, child_label string, parent string, parent_label string")
    s = spark.createDataFrame([(0, "low", "mid"), (1, "mid", "three"), (2, "mid", "high")], "pos int, child string, parent string")
    e = spark.createDataFrame([(0, wd + "P9", "old", "https://schema.org/mid"), (1, wd + "P2", "two", "https://schema.org/mid/"), (2, wd + "P5", None, "http://other.example/x")], "pos int, property string, label string, equivalent string")
    got = linked.subproperty_chains(h, s, e).collect()
    assert sorted((r.source, r.i.rsplit("/", 1)[1], r.j.rsplit("/", 1)[1], r.k.rsplit("/", 1)[1]) for r in got) == [("schema_p1", "low", "mid", "P3"), ("schema_p2", "P1", "mid", "high"), ("schema_p2", "P1", "mid", "three"), ("wdt3hop", "P1", "P2", "P3")]
    assert {r.source: r.n for r in linked.source_counts(spark.createDataFrame(got)).collect()} == {"schema_p1": 1, "schema_p2": 2, "wdt3hop": 1}
    two = linked.hierarchy_facts(h, spark.createDataFrame([(wd + "P1", linked.ONTOLOGY + "p")], "property string, equivalent string"), spark.createDataFrame([(linked.RESOURCE + "A", linked.ONTOLOGY + "p", linked.RESOURCE + "B"), (linked.RESOURCE + "A", linked.ONTOLOGY + "p", "x")], "s string, p string, o string"), hops=2)
    assert {(r.a[-1], r.b[-1], r.k[-2:]) for r in two.collect()} == {("A", "B", "P3"), ("A", "B", "P2")}
    assert linked.with_classes(two, spark.createDataFrame([(linked.ONTOLOGY + "p", "C")], "property string, class string"), "x").first().x == "C"


def test_reports(spark):
    rows = spark.createDataFrame([("b", "ns"), ("zz", "rk"), ("a", "ns"), (None, "x")], "v string, w string")
    assert {r.v: r.rank for r in reports.ordered(rows, "v", ["b", "a"]).where("v IS NOT NULL").collect()} == {"b": 1, "a": 2, "zz": 3}
    cell = lambda c, v: one(spark, reports.composite_cell(F.lit(c), F.lit(v)))
    assert cell("ARP-full", "gsc") and not cell("NRP-full", "ls") and cell("NRP-name", "ns") and not cell("NRP-name", "rk") and not cell("NRP-def", "ns")
    p = spark.createDataFrame([("m", "rdfs11"), ("m", "rdfs9"), ("m", "rdfs2_3")], "model string, pattern_id string")
    assert [r.pattern_id for r in reports.by_rules(p, "model").collect()] == ["rdfs9", "rdfs11", "rdfs2_3"]
