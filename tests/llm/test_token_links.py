"""Tokenizer alignment against a brute-force version, with both tokenizers run by their own libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridframe.llm import token_links, tokens

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def ranges(ids, raw_of):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(raw_of(i)), i))
        at += len(raw_of(i))
    return out


def brute(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = tokens.byte_letters()

    def raw_a(i):
        return bytes(letters[c] for c in a.id_to_token(i))

    def raw_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    plain = []
    for doc_id, text in rows:
        ta = ranges(a.encode(" " + text, add_special_tokens=False).ids, raw_a) if text else []
        tb = ranges(b.encode(text), raw_b) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(raw_a(t[2]) for t in ta) != whole or b"".join(raw_b(t[2]) for t in tb) != whole:
            ta, tb = [], []
        links, i, j = [], 0, 0
        while i < len(ta) and j < len(tb):  # two-pointer walk over overlapping ranges
            links.append((ta[i][2], tb[j][2]))
            ea, eb = ta[i][1], tb[j][1]
            i, j = i + (ea <= eb), j + (eb <= ea)
        shared = sorted({t[1] for t in ta} & {t[1] for t in tb})
        groups, before = [], 0
        for end in shared:
            groups.append(",".join(str(t[2]) for t in ta if before < t[1] <= end) + "|" + ",".join(str(t[2]) for t in tb if before < t[1] <= end))
            before = end
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        plain.append((doc_id, len(ta), len(tb), len(groups), links, sha))
    count = Counter(p for row in plain for p in set(row[4]))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return Counter((d, na, nb, ng, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), sha)
                   for d, na, nb, ng, links, sha in plain)


ODD = [(1, "naïve’s <|endoftext|> 日本語 😀 x²½ ٣"), (2, None), (3, ""), (4, "two  spaces"), (5, " lead"), (6, "a\r\n\tb"), (7, "<s> </s> <0x41> ▁x"),
       (None, "the same text"), (8, "the same text"), (8, "the same text"), (9, "ﬁ ligature"), (10, "the " * 1_500), (11, "x\x00y")]


def test_odd_rows_match_brute_force(spark):
    docs = spark.createDataFrame([(*r, 1, 2) for r in ODD], "doc_id long, text string, block int, `a.b` int").repartition(3)
    out = token_links.link_scores(docs)
    assert out.columns == COLUMNS
    assert Counter(tuple(r) for r in out.collect()) == brute(ODD)


@pytest.mark.parametrize("options", [{}, {"block_docs": 7, "step_bytes": 3000}])
def test_documents_match_brute_force(spark, options):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(80)
    rows = [tuple(r) for r in docs.collect()]
    got = token_links.link_scores(spark.createDataFrame(rows, docs.schema).repartition(4), **options).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_empty_table(spark):
    out = token_links.link_scores(spark.createDataFrame([], "doc_id long, text string"))
    assert out.collect() == [] and out.columns == COLUMNS


def test_postings_round_trip():
    rng = np.random.default_rng(3)
    n_docs = 500
    pair = np.where(rng.random(20_000) < 0.3, 7, rng.integers(0, 3000, 20_000))
    doc = rng.integers(0, n_docs, 20_000)
    made = token_links.encode_postings((pair << 16) | doc, n_docs)
    docs, links = token_links.decode_postings(made["dfs"], made["few"], made["many"], made["planes"], n_docs)
    got = dict(zip(zip(np.repeat(made["pairs"], made["dfs"]).tolist(), docs.tolist(), strict=True), links.tolist(), strict=True))
    assert got == Counter(zip(pair.tolist(), doc.tolist(), strict=True))
    assert len(made["many"]) == (n_docs + 7) // 8 * int((made["dfs"] * 16 > n_docs).sum()) > 0
