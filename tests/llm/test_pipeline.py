import os
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import helpers as H
import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import corpus_pipeline as P  # noqa: E402
import sqlcheck  # noqa: E402

from lumenfold.llm import mixing, packing, queries, string_kernel  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert sqlcheck.compare(spark, SF, queries.QUERIES[name], queries.ORACLES[name])


@needs_tables
def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        assert k == len(P.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
    start = spark.read.parquet(f"{SF}/documents.parquet").collect()
    language, near, clean, mix, packed = seen
    # the language stage against kernels of sets, one document at a time
    model = string_kernel.train(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in start:
        own = set(string_kernel.buckets(r["text"] or "").tolist())
        if not any(c.isalpha() for c in r["text"] or ""):
            continue
        out = model.folded[sorted(own)].sum(axis=0) / len(own) ** 0.5 + model.bias
        k = int(out.argmax())
        lift = (out[k] - model.bias[k]) / (1 - model.bias[k])
        assert (lift >= model.least[k] * min(1, len(own) / string_kernel.FULL_GRAMS)) == (r["doc_id"] in {x["doc_id"] for x in language})
    # all documents with letters have one of the learned languages
    assert {r["doc_id"] for r in language} == {r["doc_id"] for r in start if any(c.isalpha() for c in r["text"] or "")}
    want = H.components([(r["doc_id"], r["text"]) for r in language], 80, 100)
    assert sorted(r["doc_id"] for r in near) == sorted(d for d, (_, c) in want.items() if d == c)
    texts = {r["doc_id"]: r["text"] for r in clean}
    for r in near:
        spans = H.base_spans(r["text"])
        assert ("[secret]" in texts[r["doc_id"]]) == bool(spans) or "[secret]" in r["text"], r["doc_id"]
        assert not H.base_spans(texts[r["doc_id"]]) and (spans or texts[r["doc_id"]] == r["text"])
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/secret_scan/*.parquet'")
    plan = {r[0]: r[4] // r[1] for r in db.execute(mixing.ORACLE).fetchall() if r[1]}
    times = Counter(r["doc_id"] for r in mix)
    assert all(times[d] == n for d, n in plan.items())
    full = Tokenizer.from_file(packing.tokenizer_path())
    ids = {r["doc_id"]: np.asarray([*full.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4") for r in mix}
    used = defaultdict(list)
    for r in packed:
        own = ids[r["doc_id"]][r["start"] : r["start"] + 2048]
        assert (r["start"], r["length"], r["ids_crc32"]) == (2048 * r["piece"], len(own), zlib.crc32(own.tobytes()))
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in used.values():
        assert [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 2048
    pieces = Counter((r["doc_id"], r["piece"]) for r in packed)
    assert {d for d, _ in pieces} == set(times) and all(n == times[d] for (d, _), n in pieces.items())


def test_empty_corpus(spark):
    docs = H.table(spark, [])
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_edges_pass_every_stage(spark, tmp_path):
    docs = H.clashing(H.table(spark, [(1, None, None, None), (2, "", "en", "s"), (None, "no id but letters", "en", None), (4, "tie tie tie", "de", "s"), (4, "tie tie tie", "de", "s"), (5, "w " * 30000, "fr", "t")]))
    for k, (name, stage) in enumerate(P.STAGES):
        columns = docs.columns
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == len(P.STAGES) - 1 or docs.columns == columns
    assert docs.count() > 0


def test_language_stage_rejects_what_is_in_no_learned_language(spark):
    r = random.Random(21)
    stems = {
        "en": "the with thing er wh and ou st ly in".split(), "de": "sch ung keit ä der ein zu ch ver ie".split(), "fr": "eau é oi les que ç pour ment an la".split(), "es": "ción los ñ ja mi ll do que ue as".split(),
        "cz": "pří liš žlu ťou čký kůň úpěl sta rý vol".split(), "ru": "все лю ди рож да ют ся сво бод ны".split(), "noise": "q w z x k v j y p f g h".split(), "code": ["for(", "i=0;", "i++){", "x->y", "NULL", "*p", "&q", "}\n", "if(", "[i]"],
    }
    text = lambda k, n: " ".join("".join(r.choice(stems[k]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, text(k, r.choice([6, 40, 200])), k, "s") for i, k in enumerate(["en", "de", "fr", "es"] * 60)]
    planted = [(1000 + i, text(k, r.choice([20, 40, 200])), None, "s") for i, k in enumerate(["cz", "ru", "noise", "code"] * 5)]
    clean = [(2000 + i, text(k, r.choice([20, 40, 200])), None, "s") for i, k in enumerate(["en", "de", "fr", "es"] * 5)]
    out = P.language_id(spark, H.table(spark, [*rows, *planted, *clean]), "")
    assert {x["doc_id"] for x in out.collect()} == {d for d, *_ in [*rows, *clean]}
