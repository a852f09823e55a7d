"""Groups, links and corpus counts against both libraries' own encodings of whole texts."""
import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate, groupby

import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from dossier.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOK, SP = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
TOK.encode_special_tokens = True


def decoder():
    """Byte-level alphabet: printable Latin bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


DEC = decoder()


def brute(text):
    """(A ids, B ids, groups, links), straight from the definition."""
    if not text:
        return [], [], [], []
    ids_a = TOK.encode(f" {text}", add_special_tokens=False).ids
    ids_b = SP.encode(text)
    raw_a = [bytes(DEC[c] for c in TOK.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(p[1:-1], 16)]) if SP.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [SP.id_to_piece(i)]]
    raw = f" {text}".encode()
    if b"".join(raw_a) != raw or b"".join(raw_b) != raw:
        return [], [], [], []
    ea, eb = list(accumulate(map(len, raw_a))), list(accumulate(map(len, raw_b)))
    common = sorted(set(ea) & set(eb))
    of = lambda ids, e: [[i for i, _ in g] for _, g in groupby(zip(ids, e), lambda x: bisect_left(common, x[1]))]
    groups = list(zip(of(ids_a, ea), of(ids_b, eb)))
    b_at = defaultdict(list)
    for j, f in zip(ids_b, eb):
        b_at[f].append(j)
    links = [(i, j) for i, e in zip(ids_a, ea) for j in b_at[e]]
    return ids_a, ids_b, groups, links


def wanted(texts):
    all_ = [brute(t) for t in texts]
    total = Counter(x for *_, links in all_ for x in links)
    best = defaultdict(int)
    for (_, b), n in total.items():
        best[b] = max(best[b], n)
    out = []
    for a, b, groups, links in all_:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links),
                    hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return out


TEXTS = ["The quick brown fox", "The quick brown fox", "", None, " ", "  two  spaces ", "a▁b", "日本語 text", "tab\tend\n\n new line \n", "<s> <|endoftext|> </s>",
         "x y\x85z w", "naïve Äpfel 12345 don't we'll", "é \U0001f600 emoji", "a\0b", "�", " " * 70 + "x", "word " * 300, "ab" * 200]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Té\n\t'1.▁ 語́\x00\x1c᠎　s"), max_size=30))
def test_words_equal_whole_texts(text):
    got = align.Aligner.align(ALIGNER, text) or (0, 0, 0, "", [])
    a, b, groups, links = brute(text)
    assert (got[0], got[1], got[2]) == (len(a), len(b), len(groups))
    assert got[3] == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in got[4]] == links


ALIGNER = align.Aligner(A, B)


def test_words_of_a_text_are_aligned_together(monkeypatch):
    """Alone, a word costs several times what it costs among the new words of its text; only bytes that differ need that."""
    alone = align.Aligner(A, B)
    for ws in [alone.cut(f" {t}") for t in TEXTS if t]:
        ids_a, ids_b = alone.a.encode(ws), alone.b.encode(ws)
        assert alone.many(ws, ids_a, ids_b) == list(map(ALIGNER.word, ws, ids_a, ids_b))
    monkeypatch.setattr(align.Aligner, "word", None)
    assert alone.align("The quick brown fox, naïve Äpfel 12345")[:2] == tuple(map(len, brute("The quick brown fox, naïve Äpfel 12345")[:2]))


def test_counts_against_brute_force_with_and_without_the_join(spark):
    docs = spark.createDataFrame([(i if i != 3 else None, t, 0, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, pairs int, _row int").repartition(3)
    found = align.align(docs, A, B)
    want = sorted((str(i if i != 3 else None), *w) for i, w in enumerate(wanted(TEXTS)))
    for hot in (1_000_000, 5, 0):
        rows = align.judged(found, hot).collect()
        got = sorted((str(r["doc_id"]), r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"],
                      hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in rows)
        assert got == want


def test_query_on_a_given_table(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = dict(zip(docs, wanted(docs.values())))
    rows = queries.QUERIES["op13_tokenizer_alignment"](spark, sf).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want and len(rows) == len(docs)


def test_empty_table(spark):
    assert align.judged(align.align(spark.createDataFrame([], "doc_id long, text string"), A, B)).count() == 0
