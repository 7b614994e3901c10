import corpus_pipeline as c
from conftest import docs_of
from vesperflow.llm import decontaminate, quality, secrets, simhash

SF = "/root/testdata/sf0.001"


def test_stages_match_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, now = docs.columns, {r.doc_id: r for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tree = decontaminate.Automaton(items)
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == names
        got = {r.doc_id: r for r in out.collect()}
        if name == "quality":
            scores = {r.doc_id: r.predicted for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
            want = {i for i in now if scores[i]}
        elif name == "near_duplicates":
            fp = {i: simhash.simhash(r.text) for i, r in now.items()}
            want, left = set(), set(now)
            while left:
                group, todo = set(), [min(left)]
                while todo:
                    i = todo.pop()
                    if i not in group:
                        group.add(i)
                        todo += [j for j in left if (fp[i] ^ fp[j]).bit_count() <= 2]
                want.add(min(group))
                left -= group
        elif name == "decontaminate":
            want = {i for i, r in now.items() if not tree.scan(r.text)[1].any()}
        else:
            want = set(now)
            assert all(got[i].text == secrets.redact(r.text) and got[i].n_chars == len(got[i].text) for i, r in now.items())
        assert set(got) == want
        if name != "secrets":
            assert all(got[i] == now[i] for i in got)
        docs, now = spark.createDataFrame(out.collect(), out.schema), got
    packed = c.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(now)
    assert sum(r.length for r in packed) == sum(len(r.text.split()) + 1 for r in now.values())


def test_run_is_the_stages_in_turn(spark):
    assert [n for n, _ in c.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "packing"]
    assert c.run(spark, SF).count() > 0


def test_odd_rows_pass_all_stages(spark, odd, none):
    for docs in (odd, none):
        for _, stage in c.STAGES[:-1]:
            docs = stage(spark, docs, SF)
        c.STAGES[-1][1](spark, docs, SF).collect()


def test_hot_group_is_reduced_to_one(spark):
    rows = [(i, "the same words in a text that many rows hold " * 3, "s") for i in range(300)]
    assert [r[0] for r in simhash.keep_one(docs_of(spark, rows)).collect()] == [0]
