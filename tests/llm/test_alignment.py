"""Operator 11 against the two libraries and plain loops."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from storegrain.llm import align
from storegrain.llm import queries as Q

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")
PATHS = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def brute(docs):
    """[(n_a, n_b, n_groups, n_links, n_best, count_sum, groups)] of the texts."""
    left = tokenizers.Tokenizer.from_file(PATHS[0])
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    byte_of = {c: b for b, c in align.byte_alphabet().items()}
    rows, held = [], Counter()
    for text in docs:
        raw = (" " + (text or "")).encode()
        a = [(i, bytes(byte_of[c] for c in left.id_to_token(i))) for i in left.encode(" " + text, add_special_tokens=False).ids] if text else []
        names = [(i, right.id_to_piece(i)) for i in right.encode(text)] if text else []
        b = [(i, bytes([int(t[3:5], 16)]) if t.startswith("<0x") and len(t) == 6 else t.replace("▁", " ").encode()) for i, t in names]
        if not text or b"".join(t for _, t in a) != raw or b"".join(t for _, t in b) != raw:
            a = b = []
        ends = [[sum(len(t) for _, t in s[: k + 1]) for k in range(len(s))] for s in (a, b)]
        links, j = Counter(), 0
        for (i, t), e in zip(a, ends[0], strict=True):
            while ends[1][j] <= e - len(t):
                j += 1
            k = j
            while k < len(b) and ends[1][k] - len(b[k][1]) < e:
                links[i, b[k][0]] += 1
                k += 1
        groups, done = [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            upto = [s.index(e) + 1 for s in ends]
            groups.append("|".join(",".join(str(i) for i, _ in s[x:y]) for s, x, y in zip((a, b), done, upto, strict=True)))
            done = upto
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
        held.update(set(links))
    most = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    return [(na, nb, ng, sum(links.values()), sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in links.items()), g) for na, nb, ng, links, g in rows]


def test_query_is_that_of_loops(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {d: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for (d, _), w in zip(docs, brute([t for _, t in docs]), strict=True)}
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = Q.QUERIES["op11_cross_tokenizer_alignment"](spark, sf_dir)
    assert {r[0]: tuple(r)[1:] for r in got.select(*columns).collect()} == want and len(want) == len(docs)


ODD = ["", None, " ", "  a  b ", "\n\n x\ty", "▁ under", "a▁b", "<s> </s> <|endoftext|> <unk>", "日本語 テキスト 😀👍🏽", "é é ﬁ ½", "\x00\x01 <0x41>", "word " * 3000, "x" * 20_000, " " * 500, "a b c", "'s 'S don't", "word " * 3000]


@pytest.mark.parametrize("most_pairs", [1_000_000, 40, 0])
def test_odd_texts_with_pairs_sent_and_shuffled(spark, most_pairs):
    docs = spark.createDataFrame([(None if k == 3 else k % 15, t, "x", k) for k, t in enumerate(ODD)], "doc_id long, text string, pairs string, row long")
    got = align.align(docs, *PATHS, texts=True, most_pairs=most_pairs).select("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    assert sorted(map(tuple, got.collect())) == sorted(brute(ODD))
    assert align.align(docs.filter(F.lit(False)), *PATHS, most_pairs=most_pairs).count() == 0


def test_every_text_is_encoded_as_by_the_library():
    left, library = align.ByteLevel(PATHS[0]), tokenizers.Tokenizer.from_file(PATHS[0])
    library.encode_special_tokens = True
    for c in [*range(1, 0x3000), *range(0x1F300, 0x1F700), 0xFEFF, 0xFFFD]:
        text = f"a{chr(c)}b {chr(c)}1 {chr(c) * 2} .{chr(c)}  {chr(c)}"
        assert left.encode(text) == library.encode(text, add_special_tokens=False).ids
