"""Alignment of tokenizers against both libraries as they are and counts made in one place."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from folio.llm import alignment

SF = "/root/testdata/sf0.001"
LETTERS = "ab é ▁ \n\t1!'s😀<|endoftext|><s>\x1c\x85日\xa0ﬁǺ"


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_alphabet():
    """Bytes of the letters of byte-level entries."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    return letters | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def brute(texts, tokenizers):
    """A row a text, by plain offsets."""
    a, b = tokenizers
    letters, rows, linked = byte_alphabet(), [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, b.id_to_piece(k)) for k in ids_b)]
        if not text or not (b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b)):
            rows.append(None)
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            ends = [0]
            for part in parts:
                ends.append(ends[-1] + len(part))
            spans.append(list(zip(ends, ends[1:], strict=False)))
        common = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, links, last = [], [], 0
        for end in common:
            own = [[k for k, (s, e) in enumerate(side) if last <= s and e <= end] for side in spans]
            groups.append(",".join(str(ids_a[k]) for k in own[0]) + "|" + ",".join(str(ids_b[k]) for k in own[1]))
            links += [(ids_a[i], ids_b[j]) for i in own[0] for j in own[1] if spans[0][i][0] < spans[1][j][1] and spans[1][j][0] < spans[0][i][1]]
            last = end
        linked.update(set(links))
        rows.append((len(ids_a), len(ids_b), groups, links))
    most = defaultdict(int)
    for (x, _), n in linked.items():
        most[x] = max(most[x], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = row
        best, total = sum(linked[k] == most[k[0]] for k in links), sum(linked[k] for k in links)
        out.append((n_a, n_b, len(groups), len(links), best, total, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def got(df):
    return [tuple(r)[1:] for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


@pytest.mark.parametrize("hot_share", [1 << 18, 300, 1])
def test_against_brute_force(spark, tokenizers, hot_share):
    rng = random.Random(5)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.choice([3, 30, 90]))) for _ in range(60)]
    texts += [None, "", " ", "  ", "a ", " a", "a  b", "the cat sat on the mat", "the cat sat on the mat", "Unbelievably été naïve", "a\n b", "word " * 300, "x" * 5000]
    df = spark.createDataFrame([(k if k % 7 else None, t, k) for k, t in enumerate(texts)], "doc_id long, text string, pairs long").repartition(3)
    assert sorted(got(alignment.align(df, hot_share))) == sorted(brute(texts, tokenizers))


def test_query_against_brute_force(spark, tokenizers):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(rows, brute(rows.values(), tokenizers), strict=True))
    found = {r["doc_id"]: tuple(r)[1:] for r in alignment.op11_alignment(spark, SF).collect()}
    assert {k: (v[0], v[1], v[2], v[3], v[4], v[5], v[6]) for k, v in found.items()} == want


def test_no_rows_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert got(alignment.align(empty)) == []
    same = spark.createDataFrame([(1, "one text")] * 4, "doc_id long, text string")
    assert {r[5] for r in got(alignment.align(same))} == {4 * r[3] for r in got(alignment.align(same))}


def test_chunks_join_to_the_text():
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice(LETTERS + "   ") for _ in range(40))
        assert " ".join(alignment.chunks_of(text)) == text
        assert not any(not p or p[-1].isspace() for p in alignment.chunks_of(text)[:-1])
