import re
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
from offerloom.llm import decontam, pii, toxicity

from test_jaccard import brute as components
from test_packing import check
from test_pii import brute as base_spans


def test_equals_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = toxicity.fit(docs, labels, toxicity.held_out)
    texts = {r.doc_id: r.text for r in docs.collect()}
    scorer = toxicity.Scorer(net)
    texts = {d: t for d, t in texts.items() if scorer([t])[0] < 0.3}
    groups = components(texts)
    texts = {d: t for d, t in texts.items() if groups[d][1] == d}
    items = [decontam.words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def leaks(text):
        own = decontam.words(text)
        for item in items:
            if len(set(item) & set(own)) >= 0.4 * len(set(item)):
                number = {}
                a, b = (np.array([number.setdefault(w, len(number)) for w in x]) for x in (item, own))
                if decontam.align(a, b)[0] >= min(len(item), 60):
                    return True
        return False

    texts = {d: t for d, t in texts.items() if not leaks(t)}
    for d, t in texts.items():
        assert {s for s in base_spans(t)} <= set(pii.spans(t))
        texts[d] = pii.redacted(t, pii.spans(t))
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", texts[d])
    got = [SimpleNamespace(**r.asDict()) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    check(texts, got)


def test_every_stage_returns_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_rows_without_an_id_are_judged_by_their_own_text(spark, tmp_path):
    item = " ".join(f"word{k}" for k in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = " ".join(f"own{k}" for k in range(40))
    rows = [(None, f"so {item} it is"), (None, "harmless"), (None, None), (3, kept), (None, kept), (None, "harmless"), (4, "same text here"), (4, "same text here"), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text or "") for r in clean.collect()) == sorted((i or 0, t or "") for i, t in rows[1:])
    one = corpus_pipeline.keep_one_of_each_group(spark, clean, str(tmp_path))
    assert sorted((r.doc_id or 0, r.text or "") for r in one.collect()) == [(0, ""), (0, "harmless"), (3, kept), (4, "same text here"), (5, "")]
