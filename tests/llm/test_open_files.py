"""Models of many parts are read with few open files."""

import subprocess
import sys

CODE = """
import resource, sys
sys.path.insert(0, {repo!r})
import numpy as np
from chobo.llm._store import Maps, write_array
for p in range(4096):
    write_array(f"{folder}/words-{{p}}", np.arange(p % 7, dtype=np.uint64))
resource.setrlimit(resource.RLIMIT_NOFILE, (512, 512))
maps = Maps()
for turn in range(2):
    for p in range(4096):
        assert len(maps.get(f"{folder}/words-{{p}}", np.uint64)) == p % 7
assert len(maps.open) == 128
print("fine")
"""


def test_4096_parts_with_512_descriptors(tmp_path):
    import chobo

    repo = chobo.__file__.rsplit("/", 2)[0]
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=repo, folder=tmp_path)], capture_output=True, text=True, timeout=300)
    assert out.stdout.strip() == "fine", out.stderr[-2000:]


def test_models_of_many_parts_score_alike(spark, monkeypatch):
    """A reader that keeps two maps gives what one that keeps all does."""
    from chobo.llm import _store, lm_score

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 41}" for j in range(30))) for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(lm_score, "PART_BYTES", 256)
    model = lm_score.train(docs, order=3)
    assert model.parts > 16
    reader, few = lm_score._Reader(model), lm_score._Reader(model)
    few.maps = _store.Maps(2)
    h = [lm_score._text.words(*lm_score._text.utf8(docs.select("text").toArrow().column(0)))[k] for k in (2, 3)]
    a, b = (lm_score._sequences(r, *lm_score._with_end(*h)) for r in (reader, few))
    assert all((x == y).all() for x, y in zip(a, b, strict=True)) and len(few.maps.open) == 2 < len(reader.maps.open)
