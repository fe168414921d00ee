from quillspark.operators import evidence

REGISTRY = {"clarity": ("text", ()), "candour": ("text", ("responding_to",)), "vision": ("search", ("criterion", "resolve_by")), "constancy": ("record", ("proposition",))}
GOOD = "A whole sentence."


def test_gate_by_tier_and_required_fields(spark):
    cases = [
        (("clarity", GOOD, "verbatim", {}, "0.4", None), (None, None, 0.4, None)),
        (("clarity", GOOD, "verbatim", {}, " 7 ", "0.2"), (None, None, 1.0, None)),
        (("clarity", GOOD, "verbatim", {}, "-1", None), (None, None, 0.0, None)),
        (("clarity", "", "missing", {}, "0.4", None), ("empty", None, None, None)),
        (("clarity", None, "verbatim", {}, "0.4", None), ("empty", None, None, None)),
        (("clarity", GOOD, "spliced", {}, None, None), ("quote:spliced", None, None, None)),
        (("clarity", GOOD, None, {}, "0.4", None), ("quote:unknown", None, None, None)),
        (("clarity", "cut off at its start.", "verbatim", {}, "0.4", None), ("quote:mid_sentence", None, None, None)),
        (("clarity", "Cut off at its end", "verbatim", {}, "0.4", None), ("quote:mid_sentence", None, None, None)),
        (("clarity", GOOD, "verbatim", {}, None, None), ("clarity:no_score", None, None, None)),
        (("clarity", GOOD, "verbatim", {}, "high", None), ("clarity:no_score", None, None, None)),
        (("clarity", GOOD, "verbatim", {}, "NaN", None), ("clarity:no_score", None, None, None)),
        (("candour", GOOD, "verbatim", {"responding_to": ""}, "0.4", None), ("candour:missing_responding_to", None, None, None)),
        (("candour", GOOD, "verbatim", None, "0.4", None), ("candour:missing_responding_to", None, None, None)),
        (("candour", GOOD, "verbatim", {"responding_to": "q"}, "0.4", None), (None, None, 0.4, None)),
        (("vision", GOOD, "verbatim", {"criterion": "c"}, None, "0.3"), ("vision:missing_resolve_by", None, None, None)),
        (("vision", GOOD, "verbatim", {"criterion": "c", "resolve_by": "2027"}, "0.9", "0.3"), (None, None, None, 0.3)),
        (("vision", GOOD, "verbatim", {"criterion": "c", "resolve_by": "2027"}, "0.9", None), (None, None, None, 0.9)),
        (("vision", GOOD, "verbatim", {"criterion": "c", "resolve_by": "2027"}, None, None), (None, "vision:no_prior", None, None)),
        (("vision", GOOD, "verbatim", {"criterion": "c", "resolve_by": "2027"}, "0.9", "no"), (None, "vision:no_prior", None, None)),
        (("constancy", GOOD, "verbatim", {"proposition": "p"}, "0.9", "0.1"), (None, None, None, None)),
        (("new", GOOD, "verbatim", {}, "0.9", None), (None, None, None, None)),
    ]
    rows = spark.createDataFrame([(k, *given) for k, (given, _) in enumerate(cases)], "k int, attribute string, statement string, quote_class string, fields map<string,string>, score string, prior_score string")
    got = {r["k"]: (r["reason"], r["remark"], r["gated_score"], r["gated_prior"]) for r in evidence.gated(rows, REGISTRY).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}
    assert {r["attribute"]: r["tier"] for r in evidence.gated(rows, REGISTRY).collect()} == {"clarity": "text", "candour": "text", "vision": "search", "constancy": "record", "new": "unknown"}
