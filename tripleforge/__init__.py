"""A PySpark-native engine for RDFS entailment data: patterns, variants, prompts, scoring, reports and audits over triples."""
