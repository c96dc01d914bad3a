import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_catch_what_is_planted_and_keep_the_rest(spark, tmp_path):
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    docs, labels = [], []
    add = lambda t, s=0: docs.append((len(docs), t, "en", f"s{s}", len(t))) or len(docs) - 1
    clean = [add("\n".join(say(20) + "." for _ in range(4)), i % 12) for i in range(60)]
    junk = [add(" ".join(word() + r.choice(["!!", "&&&", "###"]) for _ in range(40))) for _ in range(40)]
    labels = [(i, 1) for i in clean] + [(i, 0) for i in junk]
    copy = [add(docs[clean[0]][1] + " more") for _ in range(2)]
    near = [add(docs[clean[1]][1].replace("a", "a", 1) + " " + word())]
    item = say(14)
    leak = [add(say(30) + " " + item.upper() + " " + say(30) + ".")]
    line = "All rights reserved by nobody at all."
    lined = [add(say(25) + ".\n" + line, s) for s in range(12)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = d.columns
        d = stage(spark, d, str(tmp_path))
        seen[name] = {x.doc_id: x for x in d.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert d.columns == before
    assert set(seen["quality"]) == set(range(len(docs))) - set(junk)
    assert all(line not in seen["lines"][i].text for i in lined[1:]) and line in seen["lines"][lined[0]].text
    assert all(x.n_chars == len(x.text) for x in seen["lines"].values())
    assert set(seen["near_copies"]) == set(seen["quality"]) - set(copy) - set(near)
    assert set(seen["benchmark"]) == set(seen["near_copies"]) - set(leak)
    assert set(seen["pieces"]) == set(seen["benchmark"]) and set(clean) <= set(seen["pieces"])
    again = {tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {tuple(x) for x in seen["pieces"].values()}


def test_of_repeated_rows_one_stays(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text), (1, text), (2, text), (3, "other text " * 9), (3, "third text " * 9), (None, "no id"), (None, "nor here")]
    got = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([rows[0], *rows[3:]], "doc_id long, text string").collect()))
