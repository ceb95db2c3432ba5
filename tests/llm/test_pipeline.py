"""The pipeline's stages against plain versions on a small set of documents."""

import random

import corpus_pipeline
from factweave.llm.common import materialise
from factweave.llm.bpe import default_path

import plain
from test_exact import prose


def written(spark, folder, frame, item_rows, label_rows):
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(item_rows, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(label_rows, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_and_run(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(21)
    base = [prose(rng, 90, 6000) for _ in range(60)]
    passage = prose(rng, 70, 6000)
    item = prose(rng, 30, 6000)
    texts = {k: t for k, t in enumerate(base)}
    texts |= {100: base[0], 101: base[1] + " extra"}  # copies
    texts |= {110: base[10] + " " + passage, 111: passage + " " + base[11][::-1]}  # a shared passage
    texts[120] = base[12][:200] + " " + item  # a benchmark passage
    texts[130] = base[13][::-1] + " you stupid idiot you worthless scum " + base[14][::-1]
    texts[131] = "BUY NOW!! " * 60
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    written(spark, folder, docs, [(1, item), (2, None)], [(k, 1, 0) for k in range(60)])

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "BPE encoding and decoding"]
    at, seen = docs, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = materialise(stage(spark, at, folder), "stage")
        seen.append({r.doc_id: r for r in at.collect()})
        if n < 4:
            assert at.columns == docs.columns
    clean = set(range(60))
    assert {130, 131} & set(seen[0]) == set() and clean | {100, 101, 110, 111, 120} <= set(seen[0])
    prints = [(k, plain.simhash(r.text)) for k, r in seen[0].items()]
    keep = {c for c in plain.components(prints)}
    assert set(seen[1]) - {None} == keep - {None}
    words = passage.split()
    assert words[30] in seen[2][110].text.split() and words[30] not in seen[2][111].text.split()
    assert all(seen[2][k].text == texts[k] for k in clean & set(seen[2]))
    judged = {k: (n, hit) for k, n, hit, _ in plain.contamination([(k, r.text) for k, r in seen[2].items()], [(1, item)])}
    assert set(seen[3]) == {k for k, (n, hit) in judged.items() if not (hit and 20 * hit >= n)} and 120 not in seen[3]
    library = Tokenizer.from_file(default_path())
    for k, r in seen[4].items():
        assert list(r.ids) == library.encode(seen[3][k].text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    run = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert run == {k: list(r.ids) for k, r in seen[4].items()}


def test_an_empty_table_passes(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    written(spark, folder, docs, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
