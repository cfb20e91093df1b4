"""The pipeline's stages against brute force, each on its own input."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from test_corpus_operators import plain_components, plain_line_dedup  # noqa: E402
from test_row_operators import plain_pii, plain_quality  # noqa: E402
from test_token_operators import check_packed  # noqa: E402

from leafloom.llm import pii  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(d.columns == columns for d in seen[:-1])
    texts = [{r.doc_id: r.text for r in d.collect()} for d in seen[:-1]]

    kept = {d for d, t in texts[0].items() if not plain_quality(t)[-1]}
    assert texts[1].keys() <= kept and len(texts[1]) > 0.8 * len(kept)
    assert all(texts[1][d] == texts[0][d] for d in texts[1])

    for d, left in plain_line_dedup(list(texts[1].items())).items():
        assert texts[2].get(d, "") == left or not left.strip() and d not in texts[2]

    component = plain_components(list(texts[2].items()), 5)
    assert texts[3].keys() == {d for d, c in component.items() if c == d}

    for d, t in texts[3].items():
        found = pii.scan(t, pii._automaton())
        assert [s for s in found if s[2] in pii.BASE_KINDS] == plain_pii(t) and texts[4][d] == pii.redacted(t, found)
        assert not plain_pii(texts[4][d])

    rows = seen[5].collect()
    assert check_packed(rows, {d: [t] for d, t in texts[4].items()}, 4096) <= -(-sum(r.length for r in rows) // 4096) + 1
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == len(rows)
