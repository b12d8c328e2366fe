import corpus_pipeline
from corpus_pipeline import COLUMNS, STAGES, without_spans
from edges import DOCS, edge_docs, edge_labels, no_docs
from test_jaccard_join import sets_of

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        assert docs.columns == COLUMNS
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        assert all(r.n_chars == len(r.text) for r in rows)
        if name == "near_duplicates":
            sets = {k: sets_of(t) for k, t in after.items()}
            keys = sorted(sets)
            for i, a in enumerate(keys):
                for b in keys[:i]:
                    assert not sets[a] or 100 * len(sets[a] & sets[b]) < 75 * len(sets[a] | sets[b])
            old = {k: sets_of(t) for k, t in before.items()}
            for k in set(before) - set(after):
                assert any(j != k and 100 * len(old[k] & old[j]) >= 75 * len(old[k] | old[j]) for j in old)
        elif name != "repeated_passages":
            assert all(after[k] == before[k] for k in after)
        before = after
    assert sum(r.length for r in docs.collect()) == sum(r.doc_tokens for r in docs.where("start = 0").collect())


def test_a_text_decides_for_all_its_rows_and_no_other(spark, tmp_path):
    sf = str(tmp_path / "sf")
    words = "river stone cloud window garden paper music engine forest bridge".split()
    clean = {i: " ".join(f"{words[(i * k + k * k) % 10]}{i}{k}" for k in range(60)) for i in range(60)}
    foul = {i: " ".join(["grotfiend", "vilescum", *clean[i].split()[:20], "grotfiend"]) for i in range(30)}
    item = " ".join(f"question{k}" for k in range(20))
    labels = [(i, 0, 0) for i in clean] + [(100 + i, 0, 1) for i in foul]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = [(i, t) for i, t in clean.items()] + [(100 + i, t) for i, t in foul.items()]
    rows += [(None, foul[3]), (5, foul[4]), (None, item), (6, item + " more"), (None, clean[7]), (None, "one of a kind, told by no id at all")]
    rows += [(8, clean[8]), (8, clean[9]), (None, None), (None, "")]
    docs = spark.createDataFrame(
        [(k, t, "en", "s", len(t or ""), "z", 7) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, _row string, _tid int"
    )
    stages = dict(STAGES)
    got = [(r.doc_id, r.text) for r in stages["toxicity"](spark, docs, sf).collect()]
    poisoned = {t for _, t in rows} - {t for _, t in got}
    assert poisoned == set(foul.values())
    assert sorted(map(str, got)) == sorted(str((k, t)) for k, t in rows if t not in poisoned)

    got = [(r.doc_id, r.text) for r in stages["benchmark_passages"](spark, docs, sf).collect()]
    assert sorted(map(str, got)) == sorted(str((k, t)) for k, t in rows if t is None or "question" not in t)

    got = [(r.doc_id, r.text) for r in stages["near_duplicates"](spark, docs.where("text NOT LIKE '%grot%' OR text IS NULL"), sf).collect()]
    # the text of 9 stands under the lesser id 8 too
    want = [(8 if i == 9 else i, t) for i, t in clean.items()] + [(6, item + " more"), (None, rows[-5][1]), (None, None), (None, "")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_edges(spark, tmp_path):
    sf = str(tmp_path / "sf")
    edge_labels(spark).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    for i, docs in enumerate((edge_docs(spark).select(*COLUMNS), no_docs(spark).select(*COLUMNS))):
        for name, stage in STAGES:
            stage(spark, docs, sf).write.parquet(str(tmp_path / f"{name}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{i}"))
            if name != "packing":
                assert docs.columns == COLUMNS
                if i == 0:
                    assert {2, 3, 4} <= {r.doc_id for r in docs.collect()}
    assert DOCS.startswith("doc_id")


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).where("length > 0").count() > 0


def test_characters_cut_by_a_span_stay_whole():
    assert without_spans("aéb", [(2, 4)]) == "aé"
    assert without_spans("aéb", [(0, 2)]) == "éb"
    assert without_spans("é", [(1, 2)]) == "é"
    assert without_spans("abcdef", [(0, 2), (4, 6)]) == "cd"
