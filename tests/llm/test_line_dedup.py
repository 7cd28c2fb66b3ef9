from quotelab.llm import line_dedup as L
from quotelab.llm import queries as Q
from tests import compare

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, source string, site string, gone int"


def _brute(docs, min_sites):
    sites, first = {}, {}
    for k, (d, t, s) in enumerate(docs):
        for pos, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).update({s} - {None})
                place = (d is None, d or 0, k, pos)
                first[line.strip(" ")] = min(place, first.get(line.strip(" "), place))
    out = []
    for k, (d, t, _) in enumerate(docs):
        kept = [x for pos, x in enumerate((t or "").split("\n")) if not (len(sites.get(x.strip(" "), ())) >= min_sites and first[x.strip(" ")] != (d is None, d or 0, k, pos))]
        out.append((d, None if t is None else "\n".join(kept)))
    return out


def test_matches_sql(spark):
    ok, message, *_ = compare.compare(spark, "op9", Q.op9_line_dedup, Q.ORACLES["op9_line_dedup"], SF)
    assert ok, message


def test_equals_brute_force(spark):
    docs = [(k, f"menu\nown line {k}\n  menu \n\nfooter {k % 3}\nthree {k % 2}", f"s{k % (3 if k % 2 else 7)}") for k in range(60)]
    docs += [(100, None, "s1"), (101, "", "s2"), (102, "menu", None), (None, "menu\nonly here", "s9"), (103, "menu\n" * 3000, "s1")]
    for sites in (2, 4, 7, 8):
        df = spark.createDataFrame([(*x, "a", 1) for x in docs], DOC)
        got = L.without_boilerplate(df, sites)
        assert got.columns == df.columns
        key = lambda r: (r[0] is None, r[0] or 0)
        assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(_brute(docs, sites), key=key)


def test_sketch_and_exact_count_agree(spark):
    """Many sites around the threshold: only exact counts can part 999 from 1000 sites."""
    docs = [(k, "\n".join(["wide"] + ["edge"] * (k < 1000) + ["below"] * (k < 999)), f"site{k}") for k in range(3000)]
    got = {r.doc_id: r.text for r in L.without_boilerplate(spark.createDataFrame([(*x, "a", 1) for x in docs], DOC), 1000).collect()}
    assert got[0] == "wide\nedge\nbelow" and got[5] == "below" and got[999] == "" and got[2000] == ""


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a\nb", f"s{k}", "x", 1) for k in range(6)], DOC)
    assert [r.text for r in L.without_boilerplate(df, 4).collect()] == ["a\nb"] * 6
    assert L.drop_boilerplate(df.limit(0)).count() == 0
