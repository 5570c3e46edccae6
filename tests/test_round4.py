"""Results and plans that the fourth round's review had wrong, on small tables of the same names."""

import random
from types import SimpleNamespace

import numpy as np
from pyarrow import fs
from test_round3 import against_sql  # noqa: F401

from fabula.functions.rules import ACUTE
from fabula.llm import toxicity


def test_spoken_texts_with_marks_and_blanks_of_their_own(against_sql):  # noqa: F811
    texts = ["", " ", "  ", "a", f"a{ACUTE}", ACUTE, f" {ACUTE} ", f"{ACUTE}{ACUTE}a b{ACUTE}a", f"ba{ACUTE} \n", "\t", "á \x00 \U0001f600a", None]
    rows = [(3 * i + k, t) for i, t in enumerate(texts) for k in range(3)] + [(-4, f"a{ACUTE}"), (-2, f"a{ACUTE}"), (None, f"a{ACUTE}"), (None, " ")]
    got, want = against_sql("spoken_texts", "documents", rows, "doc_id long, text string")
    assert got == want and len(got) == len(rows)
    said = dict(got)
    assert said[1] == "" and said[4] == " " and said[13] == f"b{ACUTE}" and said[20] == f" {ACUTE} "


def test_toxicity_beyond_the_shared_table(spark, monkeypatch):
    """Scores of a table that is too large to be shared are those of the shared one, and neither texts nor words are shuffled for them."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(3)) for _ in range(200)]
    rows = [(i, " ".join(rng.choice(words[:40] if i % 3 else words) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(300, None), (300, "?"), (None, "oaf")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.fit_counts(toxicity.labelled_texts(docs, labels))
    said = lambda df: sorted(((r.doc_id, *r.stats) for r in df.collect()), key=str)
    want = said(toxicity.document_evidence(docs, model))
    monkeypatch.setattr(toxicity, "SHARED_KEYS", 3)
    monkeypatch.setattr(toxicity, "FILE_KEYS", 100, raising=False)
    found = toxicity.document_evidence(docs, model)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # of the table given
    assert said(found) == want and len(want) == len(rows)
    assert len(model.files[1]) > 3 and sum(n for files in model.files for _, n, _ in files) == model.rows.count()


def test_toxicity_files_of_a_store_that_cannot_be_mapped(tmp_path, monkeypatch):
    keys, values = np.array([-(2**63), -5, 0, 7, 2**63 - 1]), np.arange(10, dtype=np.float32).reshape(2, 5)
    files = []
    for i, (a, b) in enumerate([(0, 2), (2, 5)]):
        (tmp_path / str(i)).write_bytes(keys[a:b].tobytes() + values[:, a:b].tobytes())
        files.append((int(keys[a]), b - a, f"file://{tmp_path}/{i}"))
    far = fs.SubTreeFileSystem("/", fs.LocalFileSystem())
    asked = np.array([7, 1, -(2**63), -6, 7, 2**63 - 1, 8])
    for module in (fs, SimpleNamespace(LocalFileSystem=fs.LocalFileSystem, FileSystem=SimpleNamespace(from_uri=lambda path: (far, path.removeprefix("file://"))))):
        monkeypatch.setattr(toxicity, "pafs", module)
        toxicity.in_files.cache_clear()
        known, got = toxicity.in_files(tuple(files), 2).find(asked)
        assert known.tolist() == [True, False, True, False, True, True, False] and got[:, known].tolist() == [[3, 0, 3, 4], [8, 5, 8, 9]]
    known, got = toxicity.in_files((), 1).find(asked)
    assert not known.any() and got.shape == (1, 7) and not toxicity.in_files(tuple(files), 2).find(asked[:0])[0].size
