"""The registered queries themselves, on a small folder of tables with nulls, empty, long and repeated texts, against their SQL, public libraries or brute force."""

import hashlib
import random
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from quern.llm import byte_bpe, quality_classifier
from quern.llm.queries import ORACLES, QUERIES
from tests.llm.test_operators import SECRETS, texts

LANGS = ("en", "fr", None, "xx")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(11)
    plain = "the sea and the wind of the north is in the harbour that was for all to see with joy"
    rows = [*texts(3, 60), *[t for _, t in SECRETS], *[f"{plain} {rng.random()} {plain.upper() if i % 9 == 0 else plain}" for i in range(40)], "long " * 30_000, "x" * 9_000, "é中\U0001f600 " * 400]
    rows += [rows[0]] * 30
    docs = pd.DataFrame({"doc_id": range(len(rows)), "text": rows, "lang": [LANGS[i % 4] for i in range(len(rows))], "source": [f"s{i % 5}" if i % 7 else None for i in range(len(rows))], "n_chars": 0})
    labels = pd.DataFrame({"doc_id": range(0, len(rows), 2), "quality": [int((rows[i] or "") < "m") for i in range(0, len(rows), 2)], "toxic": 0})
    path = tmp_path_factory.mktemp("tables")
    docs.to_parquet(path / "documents.parquet")
    labels.to_parquet(path / "labels.parquet")
    return path, docs, labels


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, folder, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder[0]}/documents.parquet'")
    want = db.sql(ORACLES[name])
    got = QUERIES[name](spark, str(folder[0]))
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(r[c] for c in columns) for r in got.collect())
    assert rows == sorted(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()) and len(rows) == len(folder[1])


def test_bpe(spark, folder):
    ranks = byte_bpe.ranks(public_tokenizers.path(byte_bpe.VOCABULARY))
    own = pytest.importorskip("tiktoken").Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op4_byte_bpe"](spark, str(folder[0])).collect()}
    for d, text in zip(folder[1].doc_id, folder[1].text, strict=True):
        ids = own.encode_ordinary(text or "")
        assert got[d] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_sharding(spark, folder):
    got = {r.doc_id: r for r in QUERIES["op6_sharding"](spark, str(folder[0])).collect()}
    where: dict = {}
    for d, text in zip(folder[1].doc_id, folder[1].text, strict=True):
        raw = (text or "").encode()
        assert (got[d]["size"], got[d].text_crc32, got[d].law, got[d].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        where.setdefault(text, []).append(got[d].shard)
    counts = np.bincount([r.shard for r in got.values()], minlength=16)
    assert counts.max() - counts.min() <= 1
    assert all(sorted(r.slot for r in got.values() if r.shard == s) == list(range(n)) for s, n in enumerate(counts))
    # groups that a shard has room for are whole
    assert all(len(set(s)) == 1 for s in where.values() if len(s) <= counts.min()) and max(map(len, where.values())) > counts.min()


def test_classifier(spark, folder):
    """Scores are votes of the nearest labelled documents, here counted one by one."""
    path, docs, labels = folder
    rows = QUERIES["op10_quality_classifier"](spark, str(path)).collect()
    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    model = quality_classifier.fitted(spark, str(path))
    assert len(model.labels) == sum(zlib.crc32(str(d).encode()) % 5 != 0 for d in labels.doc_id)
    features = quality_classifier.Features()
    for r in rows[::7]:
        own = model.latent(quality_classifier.counted([docs.text[r.doc_id]], features))[0].astype(float)
        near = sorted(((float(np.clip(own @ v.astype(float), 0, 1)), y) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)
        # equal similarities at the edge may be voted by either
        edge = near[quality_classifier.NEIGHBOURS - 1][0]
        if len({y for s, y in near if abs(s - edge) < 1e-4}) < 2:
            votes = near[: quality_classifier.NEIGHBOURS]
            score = (sum(s**quality_classifier.POWER * y for s, y in votes) + 0.1 * model.prior) / (sum(s**quality_classifier.POWER for s, _ in votes) + 0.1)
            assert r.score == pytest.approx(score, abs=1e-3)


def test_empty_tables(spark, folder, tmp_path):
    for table in ("documents", "labels"):
        pd.read_parquet(folder[0] / f"{table}.parquet").iloc[:0].astype({"doc_id": "int64"} | ({"text": "str", "lang": "str", "source": "str"} if table == "documents" else {})).to_parquet(tmp_path / f"{table}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
