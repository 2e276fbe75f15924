"""Account codes followed, or preceded, by upper-case words and numbers."""

import pytest

from tiercraft.llm import pii

TEXTS = [
    ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", ["DE89 3704 0044 0532 0130 00"]),
    ("NL91ABNA0417164300 EUR 250", ["NL91ABNA0417164300"]),
    ("GB82 WEST 1234 5698 7654 32 I am", ["GB82 WEST 1234 5698 7654 32"]),
    ("pay NO93 8601 1117 947 A 5 B", ["NO93 8601 1117 947"]),
    ("é \U0001f600 MT84MALT011000012345MTLCAST001S X1", ["MT84MALT011000012345MTLCAST001S"]),
    ("REF AB12 3456 7890 DE89 3704 0044 0532 0130 00 BIC X", ["DE89 3704 0044 0532 0130 00"]),
    ("DE89370400440532013000 NL91ABNA0417164300 GB82WEST12345698765432 X", [
        "DE89370400440532013000", "NL91ABNA0417164300", "GB82WEST12345698765432"]),
    ("BE68539007547034 DE89 3704 0044 0532 0130 01 BIC", ["BE68539007547034"]),
    ("IBAN DE89 3704 0044 0532 0130 00X", []),
    ("IBAN DE89 3704 0044 0532 0130", []),
]


@pytest.mark.parametrize("times", [1, 100])
def test_ibans_end_where_their_country_says(spark, times):
    df = spark.createDataFrame([(i, f"{t} ; " * times) for i, (t, _) in enumerate(TEXTS)], "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        got = [r.text[s["start"]:s["end"]] for s in r.pii_spans if s["kind"] == "iban"]
        assert got == TEXTS[r.doc_id][1] * times, r.text[:80]


def test_lengths_are_of_one_country_each():
    codes = " ".join(pii.IBAN_LENGTHS.values()).split()
    assert len(codes) == len(set(codes)) and all(len(c) == 2 for c in codes)


def test_of_overlapping_ibans_the_leftmost_stays(spark):
    def span(kind, start, end):
        return (kind, start, end, 0.7)
    rows = [(1, [span("iban", 0, 10), span("iban", 5, 20), span("iban", 12, 30), span("iban", 30, 40)]),
            (2, [span("iban", 0, 10)]), (3, []), (4, [span("iban", 0, 10), span("iban", 10, 20)])]
    df = spark.createDataFrame(rows, f"id long, s {pii._SPAN}")
    got = {r.id: [x["start"] for x in r.s] for r in df.select("id", pii._apart(df.s).alias("s")).collect()}
    assert got == {1: [0, 12, 30], 2: [0], 3: [], 4: [0, 10]}
