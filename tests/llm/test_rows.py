"""Operators that work row by row, against plain Python and the tokenizers library."""

import hashlib
import re
import struct
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanveil.llm import bpe, licenses, pii, quality, token_counts
from spanveil.llm.queries import tokenizer

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def same(df, expected):
    assert Counter(map(tuple, df.collect())) == Counter(expected)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_token_counts(docs, rows, nothing, library):
    expected = []
    for r in rows:
        text = r[1] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        expected.append((r[0], len(text.encode()), n, n > 2048))
    same(token_counts.token_counts(docs, tokenizer()), expected)
    assert token_counts.token_counts(nothing, tokenizer()).count() == 0


def test_counts_do_not_depend_on_the_table(docs, monkeypatch):
    monkeypatch.setattr(token_counts, "COUNTERS", 8)
    monkeypatch.setattr(token_counts, "FAN", 2)
    small = token_counts.token_counts(docs, tokenizer(), frequent=4).collect()
    assert Counter(small) == Counter(token_counts.token_counts(docs, tokenizer()).collect())


def test_bpe(docs, rows, nothing, library):
    expected = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((r[0], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    same(bpe.digested(docs, tokenizer()), expected)
    assert bpe.digested(nothing, tokenizer()).count() == 0


PIECES = st.lists(st.sampled_from(["'s", "'LL", "é", "Σ", "ab", "aaaa", "lol", "12", "<|endoftext|>", "<|", "?!", " ", " ", "\n", "中", "🙂", "é", "</w>"]) | st.text(max_size=6), max_size=20)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_automaton_gives_what_the_library_gives(parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    library = Tokenizer.from_file(tokenizer()) if not hasattr(test_automaton_gives_what_the_library_gives, "t") else test_automaton_gives_what_the_library_gives.t
    test_automaton_gives_what_the_library_gives.t = library
    ids = library.encode(text, add_special_tokens=False).ids
    packed, decoded = bpe.encoder(tokenizer()).text(text.encode())
    assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == ids
    assert decoded.decode() == library.decode(ids, skip_special_tokens=False)

def plain_automaton(n, merges):
    """All arcs written out, gadget by gadget."""
    arcs = {x: set(range(n)) for x in range(n)}
    for u, v, w in merges:
        arcs[w] = set(arcs[v])
        arcs[u].discard(v)
        for x in arcs:
            if u in arcs[x]:
                arcs[x].add(w)
    return arcs


def test_compiled_arcs_are_those_of_the_gadgets():
    import random

    import numpy as np

    rng = random.Random(4)
    for _ in range(40):
        base = rng.randint(1, 4)
        tokens, arcs, merges = {k: [k] for k in range(base)}, {x: set(range(base)) for x in range(base)}, []
        for w in range(base, base + rng.randint(1, 25)):
            pairs = [(u, v) for u in arcs for v in arcs[u] if tokens[u] + tokens[v] not in tokens.values()]
            if not pairs:
                break
            u, v = rng.choice(pairs)
            merges.append((u, v, w))
            tokens[w] = tokens[u] + tokens[v]
            arcs = plain_automaton(base, merges)
        automaton = bpe.Automaton(tokens, merges)
        for x in tokens:
            found = automaton.follows(np.full(len(tokens), x), np.array(sorted(tokens)))
            assert {y for y, f in zip(sorted(tokens), found, strict=True) if f} == arcs[x], (merges, x)


def test_long_words_and_words_together_give_the_same(library, monkeypatch):
    import random

    rng = random.Random(2)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 90))).encode() for _ in range(300)] + [b"a" * 3000]
    automaton = bpe.encoder(tokenizer()).automaton
    told = [library.encode(w.decode(), add_special_tokens=False).ids for w in words]
    assert automaton.encode(words) == told
    monkeypatch.setattr(bpe, "LONGEST", 0)
    assert automaton.encode(words) == told
    monkeypatch.setattr(bpe, "LONGEST", 10_000)
    monkeypatch.setattr(bpe, "TOGETHER", 7)
    assert automaton.encode(words) == told


def test_forgotten_pieces_are_encoded_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 2)
    monkeypatch.setattr(bpe, "KEPT", 3)
    made = bpe.Encoder(bpe.compiled(tokenizer()))
    for text in ["one two three", "three été", "J\u030c x", "one <|endoftext|>two", "", "two's 12"] * 2:
        ids, decoded = made.text(text.encode())
        told = library.encode(text, add_special_tokens=False).ids
        assert ids == b"".join(i.to_bytes(4, "little") for i in told) and decoded.decode() == library.decode(told, skip_special_tokens=False)


def test_latin_letters_are_split_and_lowered_as_the_library_does(library):
    import random

    rng = random.Random(8)
    letters = [chr(c) for c in range(0xA0, 0x260)]
    texts = [f"a{c}b {c}{c} 1{c}x {c}." for c in letters] + ["".join(rng.choice([*letters, "a", "Z", " ", "'s", ".", "7", "\u0301"]) for _ in range(12)) for _ in range(3000)]
    made = bpe.Encoder(bpe.compiled(tokenizer()))
    for text, (ids, decoded) in zip(texts, made.texts([t.encode() for t in texts]), strict=True):
        told = library.encode(text, add_special_tokens=False).ids
        assert ids == b"".join(i.to_bytes(4, "little") for i in told), text
        assert decoded.decode() == library.decode(told, skip_special_tokens=False)


@pytest.mark.parametrize("operator", [lambda docs, path: bpe.digested(docs, path), lambda docs, path: token_counts.token_counts(docs, path)])
def test_other_tokenizer_files_are_refused(docs, operator):
    with pytest.raises(ValueError, match="word ends"):
        operator(docs, public_tokenizers.path("byte_bpe_50k.json"))


def plain_licenses(text):
    """The same rules, tried one by one on every text, without keywords or gates."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    norm = f" {' '.join(words)} "
    found = []
    for label, priority, strength, _, pattern in licenses.RULES:
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", norm):
            start = norm.count(" ", 0, m.start()) - 1
            found.append((start, -(start + m.group().count(" ") + 1), priority, label, strength))
    outer, end = [], -1
    for d in sorted(found):
        if -d[1] > end:
            outer.append(d)
            end = -d[1]
    kept = [
        d for k, d in enumerate(outer)
        if not (k and -outer[k - 1][1] > d[0] and outer[k - 1][2] <= d[2])
        and not (k + 1 < len(outer) and outer[k + 1][0] < -d[1] and outer[k + 1][2] < d[2])
    ]
    base = {label for _, label in places}
    return (
        len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None,
        ",".join(sorted(base)), ",".join(sorted(base | {d[3] for d in kept})), max((d[4] for d in kept), default=0.0),
    )


LICENSE_TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "SPDX-License-Identifier: GPL-3.0-or-later", "This is CC BY-NC-SA 4.0 and CC BY, CC BY too. All rights reserved!",
    "GNU General Public License, version 3. general public license", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy",
    "Copyright (c) 1999 2001 x. Neither the name of the y nor the names of its contributors may be used to endorse", "ACC BYE", "öCC BY", "cc  by\ncc\tby",
]


def test_licenses(spark, docs, rows, nothing):
    more = spark.createDataFrame([(k, t) for k, t in enumerate(LICENSE_TEXTS)], "doc_id long, text string")
    same(licenses.licenses(docs), [(r[0], *plain_licenses(r[1])) for r in rows])
    same(licenses.licenses(more), [(k, *plain_licenses(t)) for k, t in enumerate(LICENSE_TEXTS)])
    by_id = {r.doc_id: r for r in licenses.licenses(more).collect()}
    assert by_id[0].labels == "apache-2.0" and by_id[1].labels == "gpl-3.0" and by_id[1].score == 1.0
    assert by_id[2].n_base == 4 and by_id[2].base_labels == "cc-by,reserved" and "cc-by-nc-sa" in by_id[2].labels
    assert licenses.licenses(nothing).count() == 0
    assert len(licenses.RULES) > 250


def shortest(pattern):
    """The shortest texts of a pattern, one for each choice of alternatives."""
    out = [""]
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [chr(arg[0][1]) if str(arg[0][0]) == "LITERAL" else "0" if "DIGIT" in str(arg[0][1]) else "x"]
        elif name == "BRANCH":
            more = [x for branch in arg[1] for x in shortest(branch)]
        elif name == "SUBPATTERN":
            more = shortest(arg[3])
        else:
            assert name == "MAX_REPEAT"
            more = [x * arg[0] for x in shortest(arg[2])] if arg[0] else [""]
        out = [a + b for a in out for b in more]
    return out


def test_no_rule_is_hidden_by_its_keyword_or_the_gate():
    for label, _, _, key, pattern in licenses.RULES:
        for text in shortest(re._parser.parse(pattern)):
            assert key in text and re.search(licenses.GATE, text), (label, text)


def plain_pii(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])) % 10 == 0:
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="0123456789. -+()@ab_%é", max_size=60))
def test_base_patterns(text):
    assert pii.base_spans(text) == plain_pii(text)


PII_TEXTS = [
    "mail jo.smith+x@mail.example.com or +44 (020) 7946-0958 today", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "host 10.0.0.1 or 300.1.1.1",
    "+1 (212) 555-0187, ann@b.co", "call +1 (212) 555-0187 now", "at 192.168.1.254 port 80", "pay 5500005555555559 please", "x@y", "é@b.c", "version 4.0. of 2.1",
]


def test_personal_data(spark, docs, rows, nothing):
    texts = [f"{w} {t}" for t in PII_TEXTS for w in ("so", "then we", "the note says", "again")]
    more = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    found = pii.personal_data(more).collect()
    assert len(found) == len(texts) + 1
    for r in found:
        base = plain_pii(texts[r.doc_id]) if r.doc_id is not None else []
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(base)]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(","))
    assert pii.personal_data(docs).count() == len(rows)
    assert pii.personal_data(nothing).count() == 0


def test_overlapping_windows_and_reconciliation():
    text = "a" * 60 + " 10.0.0.1 " + "b" * 90 + " x@y.z"
    starts = pii.windows(pii.classes(text))
    hits = [k for k, c in enumerate(text) if c in "0123456789@"]
    assert all(any(s <= h < s + pii.WIDTH for s in starts) for h in hits)
    assert all(any(s <= h < s + pii.WIDTH for h in hits) for s in starts)
    found = {(0, 0, 10): [0.9, 0.9], (1, 8, 20): [0.95], (2, 10, 30): [0.9], (3, 5, 40): [0.5]}
    assert pii.reconciled(found) == [(0, 0, 10), (2, 10, 30)]


def test_the_tagger_learns_held_out_spans():
    import random

    import numpy as np

    rng = random.Random(1)

    def make(n):
        xs, ys, texts, base = [], [], [], []
        for _ in range(n):
            ip, mail = ".".join(str(rng.randint(0, 255)) for _ in range(4)), f"u{rng.randint(1, 99)}@m{rng.randint(1, 9)}.example.com"
            text = f"{'word ' * rng.randint(1, 5)}{rng.choice([ip, mail, '3.14', str(rng.randint(1, 9999))])}{' more' * rng.randint(1, 5)}"
            spans = pii.base_spans(text)
            x, y = np.zeros(pii.WIDTH, np.uint8), np.zeros(pii.WIDTH, np.int64)
            x[: len(text)] = pii.classes(text)
            for k, s, e in spans:
                y[s:e], y[s] = 2 + 2 * k, 1 + 2 * k
            xs.append(x), ys.append(y), texts.append(text), base.append(spans)
        return np.array(xs), np.array(ys), texts, base

    x, y, _, _ = make(200)
    tagger = pii.Tagger()
    tagger.fit(x, y, steps=60)
    _, _, texts, base = make(100)
    alone = pii.added_spans(tagger, texts, [[] for _ in texts])
    hits = sum(len(set(a) & set(b)) for a, b in zip(alone, base, strict=True))
    assert hits >= 0.8 * sum(map(len, base))
    assert sum(map(len, alone)) <= 1.2 * sum(map(len, base))
    assert pii.added_spans(tagger, texts, base) == [[s for s in a if not any(s[1] < e and t < s[2] for _, t, e in b)] for a, b in zip(alone, base, strict=True)]


def plain_quality(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base(docs, rows, nothing):
    found = quality.rules(docs)
    same(found.drop("kept"), [(r[0], *plain_quality(r[1])) for r in rows])
    assert not [r for r in found.collect() if r.base_failed and r.kept]
    assert quality.rules(nothing).count() == 0


def test_quality_divergence(spark):
    clean = "the cat of the house and a dog in the garden is that which it was for all of us to see " * 2
    clean = [" ".join(f"{w}{k}" if n % 4 == 0 else w for n, w in enumerate(clean.split()) for k in [i * n % 7]) for i in range(40)]
    clean = [f"{t} {' '.join(f'w{i}x{j}' for j in range(80))}" for i, t in enumerate(clean)]
    rows = [(k, t, "en") for k, t in enumerate(clean)] + [(100, " | ".join(f"q{j}z" for j in range(120)), "en"), (101, " ".join(f"q{j}z***" for j in range(120)), "en"), (102, " | ".join(f"q{j}z" for j in range(120)), "zz")]
    kept = {r.doc_id: r.kept for r in quality.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[k] for k in range(40)) and not kept[100] and not kept[101] and kept[102]
