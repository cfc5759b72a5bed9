"""Similarity joins, first-seen clusters and the period merge against plain loops; trees, table order, roles."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docloom.functions import numbers as nb
from docloom.functions import script
from docloom.operators import contents, metrics, structure, tables
from docloom.operators.similarity import components, first_seen, similar_pairs
from docloom.plans.catalogue import QUERIES
from docloom.sources.scratch import Scratch

SF = "/root/testdata/sf0.01"


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def strange(rng, n, alphabet="abcdé", longest=16):
    out = set()
    while len(out) < n:
        s = "".join(rng.choices(alphabet, k=rng.randrange(0, longest)))
        out.add(s)
        for _ in range(3):  # near ones
            t = list(s)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randrange(2)] = rng.choices(alphabet, k=rng.randrange(2))
            out.add("".join(t))
    return sorted(out)[:n]


@pytest.mark.parametrize(("least", "seed"), [(0.84, 1), (0.85, 2), (0.6, 3), (0.95, 4)])
def test_similar_pairs_equal_brute_force(spark, least, seed):
    rng = random.Random(seed)
    keys = [(k, g) for g in ("x", None) for k in strange(rng, 90)]
    df = spark.createDataFrame([*keys, keys[0], (None, "x")], "k string, g string")
    got = {(r.g, r.a, r.b): (r.ratio_ab, r.ratio_ba) for r in similar_pairs(df, "k", ["g"], least).collect()}
    want = {}
    for g in ("x", None):
        own = sorted(k for k, h in keys if h == g)
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if ratio(a, b) >= least or ratio(b, a) >= least:
                    want[g, a, b] = (ratio(a, b), ratio(b, a))
    assert got == want and len(want) > 10


def test_similar_pairs_have_no_python_before_candidates(spark):
    df = spark.createDataFrame([("abc", "g")], "k string, g string")
    plan = similar_pairs(df, "k", ["g"], 0.84)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") >= 1 and "applyInPandas" not in plan and "FlatMapGroups" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_first_seen_equals_a_loop(spark):
    rng = random.Random(3)
    for n, m in ((40, 60), (60, 30), (30, 200)):
        keys = [(f"k{i}", i) for i in range(n)]
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} | {(i, i + 1) for i in range(8)}
        df = spark.createDataFrame([(f"k{a}", f"k{b}") for a, b in edges], "early string, late string")
        got = {r.key: r.leader for r in first_seen(spark.createDataFrame(keys, "key string, at int"), df, Scratch(spark, "t")).collect()}
        leaders, want = [], {}
        for i in range(n):
            found = next((x for x in leaders if (x, i) in edges), None)
            want[f"k{i}"] = f"k{i if found is None else found}"
            leaders += [i] if found is None else []
        assert got == want


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    n, edges = 80, [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(i, i + 1) for i in range(20, 36)]
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    nodes = spark.range(n).select(F.col("id").alias("node"))
    got = {r.node: r.component for r in components(nodes, spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: root(i) for i in range(n)}


def plain_clusters(works):
    """First-seen clusters of (author, position), names blocked by the initial consonants of their words."""
    import re

    initials = lambda k: "".join(re.sub("[^bcdfghjklmnpqrstvwxyz]", "", w)[:1] for w in k.split(" "))
    at = {}
    for name, i in works:
        at[name] = min(i, at.get(name, i))
    of = {n: script.person_key_text(n) for n in at}
    first = {}
    for n in sorted(at, key=lambda n: (at[n], n)):
        first.setdefault(of[n], n)
    leaders, cluster = [], {}
    for k in sorted(first, key=lambda k: (at[first[k]], first[k])):
        found = next((x for x in leaders if initials(x) == initials(k) and script.same_person_text(x, k)), None)
        cluster[k] = found if found is not None else k
        leaders += [k] if found is None else []
    return {n: first[cluster[of[n]]] for n in at}


def test_author_clusters_of_random_names(spark):
    rng = random.Random(8)
    given, family = ["anil", "aneel", "sunita", "suneeta", "kavita", "kavitha", "rajesh", "rajeshh", "nita"], ["kumar", "kumaar", "kumari", "arora", "aroraa", "sen", "rao", "sharma", "sharmaa"]
    works = [(f"{rng.choice(given)} {rng.choice(family)}".title() if rng.random() < 0.8 else rng.choice(given), rng.randrange(200)) for _ in range(300)]
    got = {r.author: r.cluster for r in contents.author_clusters(spark.createDataFrame(works, "author string, position int")).collect()}
    assert got == plain_clusters(works) and len(set(got.values())) < len(got)


def test_author_clusters_query(spark):
    rows = spark.read.parquet(f"{SF}/part.parquet").select(F.initcap("p_name"), "p_partkey").collect()
    assert {r.author: r.cluster for r in QUERIES["author_clusters"](spark, SF).collect()} == plain_clusters([tuple(r) for r in rows])


def plain_merge(records):
    """{record: merged key} of (section, region, metric, period, position), one by one in order; equal records share their fate."""
    out = {}
    for group in {r[:2] for r in records}:
        rows = {}
        for r in sorted({r for r in records if r[:2] == group}, key=lambda r: (r[4], r[2], r[3])):
            _, _, m, p, _ = r
            if m not in rows:
                best, match = 0.0, None
                for k, held in rows.items():
                    if p not in held and ratio(k, m) >= 0.85 and ratio(k, m) > best:
                        best, match = ratio(k, m), k
                m = match or m
            rows.setdefault(m, set()).add(p)
            out[r] = m
    return out


def merged(spark, data):
    df = spark.createDataFrame(data, "section string, region string, metric_key string, period string, position int")
    return {tuple(r)[:5]: r.merged_key for r in metrics.fuzzy_merge(df, ["section", "region"]).select("section", "region", "metric_key", "period", "position", "merged_key").collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fuzzy_merge_of_random_records(spark, seed):
    rng = random.Random(seed)
    names = ["total letters", "total lettrs", "totl letters", "letters total", "meetings held", "meeting held", "meetings heId", "staff", "notings in hindi", "notings in english", "noting in hindi"]
    data = [(f"s{rng.randrange(2)}", rng.choice(["क", None]), rng.choice(names), rng.choice(["2023", "2024", "2025"]), rng.randrange(60)) for _ in range(150)]
    got = merged(spark, data)
    assert got == plain_merge(data) and any(k[2] != v for k, v in got.items())


def test_fuzzy_merge_splits_a_hot_group(spark):
    """One section of many metrics falls into its ties; a metric without ties meets no Python."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(700)]
    data = [("s", None, w, p, 2 * i) for i, w in enumerate(words) for p in ("2023", "2024")] + [("s", None, f"{w}x", "2025", 2 * i + 1) for i, w in enumerate(words[:200])]
    got = merged(spark, data)
    assert got == plain_merge(data) and sum(k[2] != v for k, v in got.items()) >= 200


def test_fuzzy_merge_of_a_metric_repeated_in_a_period(spark):
    data = [("s", "r", "total letters", "2023", 0), *[("s", "r", "total lettrs", "2024", i) for i in range(1, 9)], *[("s", "r", "totl letters", "2024", i) for i in range(9, 12)]]
    got = merged(spark, data)
    assert got == plain_merge(data) and got[data[1]] == "total letters" and got[data[8]] == "total lettrs"


def test_period_fuzzy_merge_query(spark):
    got = {(r.section, r.metric_key, r.period, r.position): r.merged_key for r in QUERIES["period_fuzzy_merge"](spark, SF).collect()}
    want = plain_merge([(s, None, m, p, at) for s, m, p, at in got])
    assert got == {(s, m, p, at): v for (s, _, m, p, at), v in want.items()} and got


# --- trees, table order, roles


def chain(depth):
    return '{"key":"k","value":null,"children":[' * depth + '{"key":"end","value":"v","children":[]}' + "]}" * depth


def test_trees_of_any_depth(spark):
    df = spark.createDataFrame([("deep", chain(5000)), ("flat", '{"key":"r","value":"1","children":[{"key":"a \\"q\\" {[","value":"x\\ny"},{"key":"b","value":3.50,"children":null}]}'), ("none", None), ("bad", '{"key": "x", "children": ['), ("list", "[1, 2]"), ("nokey", '{"value": "v"}'), ("odd", '{"key":"o","value":{"a":[1,"}"]},"other":[{"key":"no"}],"children":[{"key":"c","value":true}]}')], "document_id string, tree string")
    got = [(r.document_id, r.path, r.value) for r in structure.flatten_tree(df).collect()]
    deep = [g for g in got if g[0] == "deep"]
    assert len(deep) == 5001 and deep[-1] == ("deep", ["k"] * 5000 + ["end"], "v") and [len(p) for _, p, _ in deep] == list(range(1, 5002))
    assert [g for g in got if g[0] == "flat"] == [("flat", ["r"], "1"), ("flat", ["r", 'a "q" {['], "x\ny"), ("flat", ["r", "b"], "3.50")]
    assert [g[1:] for g in got if g[0] == "odd"] == [(["o"], '{"a":[1,"}"]}'), (["o", "c"], "true")]
    assert {g[0] for g in got} == {"deep", "flat", "odd"}


def test_trees_equal_recursion(spark):
    rng = random.Random(2)

    def tree(depth):
        return {"key": f"k{rng.randrange(9)}", "value": rng.choice([None, "v", "ü"]), "children": [tree(depth - 1) for _ in range(rng.randrange(4))] if depth else []}

    def walk(node, path):
        path = [*path, node["key"]]
        yield path, node["value"]
        for c in node["children"]:
            yield from walk(c, path)

    for _ in range(20):
        t = tree(4)
        assert list(structure.walk_tree(json.dumps(t, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])))) == list(walk(t, []))


def test_numbers_in_ids_order_as_numbers(spark):
    ids = ["d:t10", "d:t2", "d:t1", "d:p3:form", "d:p20:form", "t", ""]
    df = spark.createDataFrame([(i,) for i in ids], "table_id string")
    assert [r.table_id for r in df.orderBy(nb.natural("table_id")).collect()] == ["", "d:p3:form", "d:p20:form", "d:t1", "d:t2", "d:t10", "t"]
    cells = [("d", f"d:t{t}", r, c, v) for t in (10, 2) for r in range(6) for c, v in enumerate([f"{r + 1}.", f"title {t} {r}", "anil kumar", str(r + 5)])]
    got = contents.toc_from_cells(spark.createDataFrame(cells, "document_id string, table_id string, row_index int, col_index int, value string"))
    assert {r.table_id for r in got.collect()} == {"d:t2"}
    twice = spark.createDataFrame([("d", f"d:t{t}", 1, ["h"], [["a"]]) for t in (10, 2)], "document_id string, table_id string, page_number int, headers array<string>, rows array<array<string>>")
    assert [r.table_id for r in tables.dedup_tables(twice).collect()] == ["d:t2"]


def test_roles_begin_words(spark):
    assert structure.roles_in("Who is the secretary?") == [["secretary", "sachiv", "सचिव"]]
    assert structure.roles_in("sachiv kaun hai")[0][0] == "secretary" and structure.roles_in("the abhiyanta")[0][0] == "engineer"
    assert structure.roles_in("undersecretaryship of the forehead") == [] and structure.roles_in("अनुवादक कौन है")[0][0] == "translator"
    df = spark.createDataFrame([("Undersecretary Rao",), ("Project engineer",)], "t string")
    assert [r[0] for r in df.select(structure.roles_present(structure.roles_in("who is the secretary"), F.col("t"))).collect()] == [True, False]
