import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tools.compare import compare, connect
from vislens.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return connect(SF)


def test_all_operators_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_and_equals_its_sql(spark, duck, name):
    ok, note, _ = compare(spark, duck, SF, name, QUERIES[name], ORACLE.get(name))
    assert ok, note


def test_pipeline_equals_its_parts_by_brute_force(spark, duck):
    from test_contamination import slow as leaks
    from test_simhash import slow_wide_groups
    from test_unit_dedup import slow as repeats
    from vislens.llm.queries import read

    docs = read(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in clean.collect())
    group = slow_wide_groups(rows)
    rows = [r for r in rows if group[r[0]] == r[0]]
    cut = {}
    for d, a, b, *_ in repeats(rows):
        cut.setdefault(d, []).append({"start": a, "end": b})
    from vislens.llm.unit_dedup import cut_spans

    rows = [(d, cut_spans(t, cut[d]) if d in cut else t) for d, t in rows]
    rows = [(d, t) for d, t in rows if d not in cut or t.split()]
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    gone = {x[0] for x in leaks(rows, items)}
    want = {d: t for d, t in rows if d not in gone}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == set(want)
    sizes, bins = {}, {}
    for r in packed:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append((r.bin_start, r.length, r.doc_id))
    assert sizes == {d: len((t or "").encode()) for d, t in want.items()}
    source = {r.doc_id: r.source for r in docs.collect()}
    for parts in bins.values():
        parts.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][0] + parts[-1][1] <= 8192
        assert len({source[p[2]] for p in parts}) == len(parts)
