import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from idloom.llm import registry  # noqa: E402
from idloom.llm.common import materialize  # noqa: E402
from tests.llm.common import frame, words  # noqa: E402
from tests.llm.test_dedup import brute, removed  # noqa: E402
from tests.llm.test_tokens import check_packed  # noqa: E402

LANGS = {"en": "abcdef", "fr": "ghijkl"}


def tables(spark, folder, seed=2):
    """Small tables: prose in two languages, junk, near copies, shared passages."""
    rng = random.Random(seed)
    pools = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(900)] for lang, letters in LANGS.items()}
    passage = words(rng, 70, pools["en"])
    rows, labels = [], []
    for i in range(240):
        lang = ["en", "fr"][i % 2]
        text = words(rng, rng.randint(60, 160), pools[lang])
        if i % 12 == 0:
            text = [w + "%%%" for w in text]
        elif i % 12 == 1:
            text = text[:20]
        elif i % 12 in (2, 3) and i > 24:
            text = rows[i - 24][1].split() if i % 24 < 4 else text
            text[rng.randrange(len(text))] = "changed"
        elif i % 12 == 4:
            text = text[:30] + passage + text[30:]
        elif i == 5:
            text = ["1234", "5678"] * 40 + [str(k) for k in range(200)]
        rows.append((i, " ".join(text), lang, f"src{i % 3}", None))
        if i % 5:
            labels.append((i, 0 if i % 12 in (0,) else 1, 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = f"{tmp_path_factory.mktemp('pipe')}"
    tables(spark, folder)
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/out-{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/out-{name}")
    return folder, out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_all_but_the_last_return_documents(stages):
    _, out = stages
    for name in ("quality", "language", "near_duplicates", "substrings"):
        assert out[name].columns == out["documents"].columns
        assert out[name].count() <= out["documents"].count()


def test_quality_rejects_junk_and_keeps_prose(stages):
    _, out = stages
    kept = {i for i, _ in pairs(out["quality"])}
    assert not {i for i in range(240) if i % 12 in (0, 1)} & kept
    assert len({i for i in range(240) if i % 12 not in (0, 1)} - kept) <= 5


def test_language_keeps_prose(stages):
    _, out = stages
    lost = {i for i, _ in pairs(out["quality"])} - {i for i, _ in pairs(out["language"])}
    assert lost <= {5}


def test_one_document_of_each_group_stays(stages):
    _, out = stages
    before = pairs(out["language"])
    assert {i for i, _ in pairs(out["near_duplicates"])} == {c for _, _, c in brute(before, 5)}


def test_one_row_of_each_group_stays_with_its_text(spark):
    rng = random.Random(4)
    a, b, c, d, e = (" ".join(words(rng, 80)) for _ in range(5))
    repeated, copied, without_ids, two_texts = [(7, a), (7, a)], [(8, b), (None, b)], [(None, c), (None, c)], [(9, d), (10, d), (10, e)]
    rows = [*repeated, *copied, *without_ids, *two_texts, (None, a + " changed"), (11, ""), (11, "")]
    want = sorted([(7, a), (8, b), (None, c), (9, d), (10, e), (11, ""), (11, "")], key=str)
    docs = frame(spark, rows)
    near = materialize(corpus_pipeline.near_duplicates(spark, docs, ""), "near")
    assert near.columns == docs.columns
    assert sorted(pairs(near), key=str) == want
    assert sorted(pairs(corpus_pipeline.repeated_passages(spark, near, "")), key=str) == want


def test_passages_are_removed(stages):
    import hashlib

    _, out = stages
    want = {d: (n, h) for d, _, n, h in removed(pairs(out["near_duplicates"]))}
    before = dict(pairs(out["near_duplicates"]))
    for i, text in pairs(out["substrings"]):
        if want[i][0]:
            assert hashlib.sha256(text.encode()).hexdigest() == want[i][1]
        else:
            assert text == before[i]
    assert any(n for n, _ in want.values())


def test_pieces_hold_every_token(stages):
    _, out = stages
    assert check_packed(out["packing"].collect(), pairs(out["substrings"])) < 0.05


def test_run_gives_the_same_pieces(spark, stages):
    folder, out = stages
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(out["packing"])


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())
