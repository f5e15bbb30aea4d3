"""The pipeline: stages keep columns, decide as their operators, hand rows on."""

import corpus_pipeline
from unitsieve.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = common.table(spark, SF, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF))
        assert docs.columns == first.columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.4 * counts[0]
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert packed.where("start = 0").count() == docs.count()


def test_pipeline_by_hand(spark):
    """Copies leave one, junk and leaks go, banners go from texts, clean rows stay."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(f"The {word()} of the {word()} and {word()} it." for _ in range(12)) for _ in range(21)]
    prose = texts.__getitem__
    rows = [(i, "Banner of the site for all of us.\n" + prose(i + 1), "en", "s", 0) for i in range(14)]
    rows += [(50, rows[0][1], "en", "s", 0), (60, "a | b | c | d | e | f | g | h | i | j | k | l", "en", "s", 0), (70, prose(20) + " LEAK one two three four five six seven eight. Nine ten eleven twelve thirteen.", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    import tempfile

    folder = tempfile.mkdtemp()
    spark.createDataFrame([(1, "LEAK one two three four five six seven eight. Nine ten eleven twelve thirteen.")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, folder))
    got = {r["doc_id"]: r for r in docs.collect()}
    assert {50, 60, 70}.isdisjoint(got) and all("Banner" not in r["text"] and r["n_chars"] == len(r["text"]) for r in got.values())


def test_near_copies_by_brute_force(spark):
    """Of two documents with a five-word likeness of 0.8 or more one goes; others stay."""
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(60):
        base = [word() for _ in range(120)]
        rows.append((2 * g, " ".join(base), "en", "s", 0))
        for at in ([30, 60] if g % 2 else range(6, 120, 12)):
            base[at] = word()
        rows.append((2 * g + 1, " ".join(base), "en", "s", 0))
    rows += [(1000 + i, rows[1][1], "en", "s", 0) for i in range(50)]
    rows += [(None, "no id", "en", "s", 0), (2000, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs, "").collect()
    kept = {r["doc_id"]: r["text"] for r in out}

    def sets(t):
        w = (t or "").split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    held = [sets(t) for t in kept.values() if t]
    assert all(len(a & b) < 0.8 * len(a | b) for k, a in enumerate(held) for b in held[:k])
    assert {None, 2000} <= set(kept) and all({2 * g} <= set(kept) and (2 * g + 1 in kept) == (g % 2 == 0) for g in range(60))


def test_entry_without_llm(tmp_path):
    """The entry still imports when the folders are gone."""
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parents[2]
    shutil.copytree(root / "unitsieve", tmp_path / "unitsieve", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'text_lines' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_stages_on_odd_rows(spark, odd, empty, docs):
    """Null ids and texts, repeated rows, two texts of one id, clashing columns, empty tables."""
    wide = odd.withColumn("__number", odd["n"]).withColumn("row", odd["n"]).withColumn("__gone", odd["n"]).withColumn("__dropped", odd["n"])
    want = {"quality rules": 0, "line dedup": 6, "near dedup": 4, "decontamination": 6}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns and out.count() == want[name], name
        assert stage(spark, empty, SF).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, wide, SF)
    assert packed.where("start = 0").count() == 6 and corpus_pipeline.packing(spark, empty, SF).count() == 0


def test_a_bucket_of_documents_that_are_not_alike(spark):
    """Many documents meet without being alike: several rounds, none lost, links among them found."""
    import random

    from unitsieve.llm import alike

    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(80):
        mine = list(base)
        for at in range(i % 7, 150, 18):  # far from all others, near in keys
            mine[at] = word()
        rows.append((i, " ".join(mine)))
    rows += [(200 + i, rows[70][1] + f" {word()}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(alike.shingle_hashes(t).tolist()) for _, t in rows]
    left = {r["doc_id"] for r in alike.drop_alike(docs).collect()}
    alone = [rows[k][0] for k in range(len(rows)) if not any(len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j]) for j in range(k))]
    assert left == set(alone) and 80 <= len(left) <= 81 and not {200, 201, 202} & left
