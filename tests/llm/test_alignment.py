"""Token alignment against a plain loop over both tokenizers, on small files and shards, odd rows and empty tables."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from odd import no_documents, odd_documents, odd_rows, words
from tokenizers import Tokenizer

from stockloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "plain words, and more plain words.\nA line\nand another", " leading", "trailing ", "two  spaces", "tab\tand\nline", "\nfirst", "last\n", "a\n\nb", "<|endoftext|> </s> <s>x", "snowman ☃ \U0001f642 ▁ mark",
    "▁", "ﬁ Ａ ｘ", "don't we'll  I'd", "日本語 テキスト　です", "a b", "x" * 3000, "<0x41> <unk>", "\r\n", "é ü ß", "\x00 nul", " ", "\n", "1 22 333 4444 55555",
]


def letters() -> dict[str, int]:
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows: list[tuple]) -> list[tuple]:
    a, b, spell = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), letters()
    a.encode_special_tokens = True
    special = {50256: b"<|endoftext|>"}
    count, docs = Counter(), []
    for i, t in rows:
        raw = b" " + (t or "").encode()
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        xb = [special.get(k) or bytes(spell[c] for c in a.id_to_token(k)) for k in x]
        yb = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, b.id_to_piece(k)) for k in y)]
        if b"".join(xb) != raw or b"".join(yb) != raw:
            x, y, xb, yb = [], [], [], []
        ends = [np.cumsum([len(p) for p in s]).tolist() for s in (xb, yb)]
        links, groups, own = [], [], [[], []]
        at = [{e: k for e, k in zip(es, s, strict=True)} for es, s in zip(ends, (x, y), strict=True)]
        for e in sorted(set(ends[0]) | set(ends[1])):
            for side in (0, 1):
                own[side] += [str(at[side][e])] if e in at[side] else []
            if e in at[0] and e in at[1]:
                links.append((at[0][e], at[1][e]))
                groups.append("|".join(map(",".join, own)))
                own = [[], []]
        count.update(links)
        docs.append((i, len(x), len(y), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
    best: dict[int, int] = {}
    for (_, k), n in count.items():
        best[k] = max(n, best.get(k, 0))
    return sorted([(i, n, m, len(ls), len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), h) for i, n, m, ls, h in docs], key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_equals_a_plain_loop(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(alignment, "PAIRS_PER_FILE", 50)
        monkeypatch.setattr(alignment, "SHARD_BYTES", 300)
        monkeypatch.setattr(alignment, "PARTIAL", 40)
    rows = list(enumerate(TEXTS)) + [(100 + i, words(i, 60).replace(" ab", "\nab")) for i in range(20)] + [(100, words(1, 30)), (None, "plain words"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, alignment.align_tokens(docs, A, B).collect()), key=repr)
    assert got == brute(rows)
    assert sum(r[1] > 0 for r in got) > 30


def test_cut_parts_give_the_ids_of_whole_texts():
    pair = alignment.Pair(A, B)
    assert pair.cut
    texts = [t for t in TEXTS if t] + [words(i, 300).replace(" ab", "\nab") for i in range(5)] + ["It's the end.\n'Quoted' words\nand (brackets) 12,5 %"]
    whole = pair._encoded(texts)
    assert pair.encode([t.encode() for t in texts]) == whole
    assert pair.encode([t.encode() for t in texts]) == whole  # known parts


def test_files_are_one_global_order(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(alignment, "PAIRS_PER_FILE", 40)
    docs = spark.createDataFrame([(i, words(i, 80)) for i in range(12)], "doc_id long, text string").repartition(4)
    shards = alignment.token_links(docs, A, B)
    files = alignment.count_files(shards, f"file://{tmp_path}").orderBy("first").collect()
    keys = np.concatenate([alignment._keys(r.links) for r in shards.select("links").collect()])
    u, n = np.unique(keys, return_counts=True)
    raw = [np.fromfile(tmp_path / r.file, "<i8").reshape(2, -1) for r in files]
    assert len(files) > 5 and np.concatenate(raw, axis=1).tolist() == [u.tolist(), n.tolist()]
    assert alignment.look_up(f"file://{tmp_path}", [(r.file, r.first, r["last"]) for r in files], u[::3]).tolist() == n[::3].tolist()


def test_odd_rows_empty_tables_and_clashing_names(spark):
    want = brute([(r[0], r[1]) for r in odd_rows()])
    for clashing in (False, True):
        assert sorted(map(tuple, alignment.align_tokens(odd_documents(spark, clashing), A, B).collect()), key=repr) == want
    assert alignment.align_tokens(no_documents(spark), A, B).count() == 0
