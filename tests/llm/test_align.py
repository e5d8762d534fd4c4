"""Cross-tokenizer alignment against a plain version over the libraries' own ids."""

import hashlib
from collections import Counter, defaultdict

import pytest

from cohortlab.llm import token_align
from cohortlab.llm.encoding import byte_letters, parts, runs, tokenizer_path
from tests.llm.cases import empty, frame, odd_documents, prose

ODD = [(400, "<|endoftext|> and <s> </s> <unk> <0x41>"), (401, "two  spaces\nand lines \n"), (402, " lead"),
       (403, "tab\tand trail "), (404, "▁ mark"), (405, "abab " * 300), (406, "ﬁ ligature Å"),
       (407, "日本語の文 \U0001f600\U0001f600\U0001f600" * 20), (408, prose(9, 60)), (409, prose(9, 60))]


def _plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path(token_align.VOCABULARY))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(token_align.PIECES))
    back = {c: i for i, c in enumerate(byte_letters())}

    def bytes_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    docs, count = [], Counter()
    for doc_id, text in rows:
        if doc_id is None:
            continue
        groups = []
        if text:
            want = (" " + text).encode()
            a = [(i, bytes(back[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes_b(i)) for i in sp.encode(text)]
            if b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
                ends = [set(), set()]
                for side, toks in enumerate((a, b)):
                    at = 0
                    for _, x in toks:
                        at += len(x)
                        ends[side].add(at)
                cuts, where = sorted(ends[0] & ends[1]), defaultdict(lambda: ([], []))
                for side, toks in enumerate((a, b)):
                    at, g = 0, 0
                    for i, x in toks:
                        at += len(x)
                        while at > cuts[g]:
                            g += 1
                        where[g][side].append(i)
                groups = [where[g] for g in range(len(cuts))]
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        count.update(set(links))
        docs.append((doc_id, groups, links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for doc_id, groups, links in docs:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out)


def _got(df, **kw):
    return sorted(tuple(r) for r in token_align.align(df, **kw).collect())


@pytest.mark.parametrize("hot", [token_align.HOT_PAIRS, 40, 0])
def test_alignment_equals_plain_version(spark, hot):
    rows = [*odd_documents(), *ODD]
    assert _got(frame(spark, rows), hot_pairs=hot) == _plain(rows)


def test_wide_groups_cut_texts_and_small_table(spark, monkeypatch):
    rows = [*odd_documents()[:8], *ODD, (500, prose(4, 3000)), (501, "z" * 3000 + " " + "日本" * 500 + " end")]
    al = token_align.Aligner()
    monkeypatch.setattr(token_align, "WIDE_GROUP", 2)
    al.table.limit = 1000
    monkeypatch.setattr(token_align, "parts", lambda t: parts(t, 50))
    monkeypatch.setattr(token_align, "runs", lambda t: runs(t, 200))
    for doc, (doc_id, text) in zip(al.documents([t for _, t in rows]), rows, strict=True):
        want = _plain([(doc_id, text)])[0]
        if doc is None:
            assert want[1] == 0
        else:
            assert tuple(doc.sizes) == want[1:5] and doc.digest.hexdigest() == want[7]
            assert doc.pairs()[1].sum() == want[4]


def test_identity_map_and_empty_table(spark):
    al = token_align.aligner()
    same = al.same_bytes
    assert (same >= 0).sum() > 5000
    assert all(al.bytes_a[i] == al.bytes_b[same[i]] for i in range(0, len(same), 97) if same[i] >= 0)
    assert token_align.align(empty(spark)).count() == 0
