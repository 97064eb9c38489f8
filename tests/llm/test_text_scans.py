"""Operators that read each text by itself (1, 3, 4, 7, 9), against plain versions."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from postsieve.llm import licenses, lines, pii, secrets, tokens

from helpers import same

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect()]


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)).encode()).hexdigest()


def plain_secrets(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return out


def test_secrets(docs):
    out = secrets.scan_secrets(docs, VOCABULARY, public_tokenizers.PATTERN)
    assert "key" in out.columns and "text" not in out.columns
    want = []
    for i, t, _ in texts_of(docs):
        s = plain_secrets(t)
        want.append((i, *[sum(x[1] == k for x in s) for k in range(3)], sha(s)))
    same(out, want, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"])


def test_random_strings():
    encoder = secrets._encoder(VOCABULARY, public_tokenizers.PATTERN)
    found = lambda t: [t[a:b] for a, b in secrets.random_runs(t, encoder, 2.0)]
    key = "xK9fQz2LmV8tRw4YbN7cJd1H"
    assert found(f"use {key} here") == [key]
    for clean in ("internationalization", "my_module_name_v2/some-path-to-file01", "d41d8cd98f00b204e9800998ecf8427e",
                  "123e4567-e89b-12d3-a456-426614174000", "2024-01-01-00-00-00-0000"):
        assert found(clean) == []
    assert secrets.listed(secrets.spans_of(f"secret={key}", encoder, 2.0)) == f"assign:0:{7 + len(key)}"
    assert secrets.listed(secrets.spans_of(key, encoder, 2.0)) == f"random:0:{len(key)}"


def test_random_letters():
    import random
    import string

    draw = random.Random(8)
    encoder = secrets._encoder(VOCABULARY, public_tokenizers.PATTERN)
    for letters in (string.ascii_lowercase, string.ascii_letters):
        keys = ["".join(draw.choice(letters) for _ in range(n)) for n in (16, 20, 32) for _ in range(100)]
        low = [k for k in keys if len(k) <= 2.0 * len(encoder.encode_ordinary(k))]
        assert len(low) > 270 and all(secrets.random_runs(k, encoder, 2.0) == [(0, len(k))] for k in low)
    for clean in ("responsibilities", "user_account_settings_2024", "getUserAccountSettings", "release-notes/2024-01-01"):
        assert secrets.random_runs(clean, encoder, 2.0) == []


def test_token_counts(docs):
    library = Tokenizer.from_file(BPE)
    out = tokens.count_tokens(docs, BPE)
    want = []
    for i, t, _ in texts_of(docs):
        n = len(library.encode(t, add_special_tokens=False).ids)
        want.append((i, len(t.encode()), n, n > 512))
    same(out, want, ["doc_id", "n_bytes", "n_tokens", "over_limit"])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB1é ßя😀  \u0085\x1c\t\n\r'sdlv.<|>٣́")), max_size=40))
def test_token_counts_of_odd_texts(text):
    own = tokens.counter(BPE)
    assert own.counts([text]) == own.encoded([text])


def plain_pii(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d))))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return out


def pii_rows(found):
    return [(i, *[sum(x[1] == k for x in s) for k in range(4)], sha(s)) for i, s in found]


PII_NAMES = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]


def test_personal_data(docs):
    out = pii.find_personal_data(docs)
    assert "text" not in out.columns and "key" in out.columns
    same(out, pii_rows((i, plain_pii(t)) for i, t, _ in texts_of(docs)), PII_NAMES)


def test_personal_data_of_odd_texts(spark, shared):
    import random

    draw = random.Random(3)
    rows = [(i, "".join(draw.choice("ab1@.-_+%4 (\nß") for _ in range(draw.randrange(60)))) for i in range(1500)]
    rows += [(5000 + i, "".join(draw.choice("0123 -.+4") for _ in range(draw.randrange(80)))) for i in range(1500)]
    rows.append((9000, "4 " * 20000 + "a@" + "b." * 20000 + "c " + "9" * 50000 + " +1" + " " * 30000))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(pii.find_personal_data(frame), pii_rows((i, plain_pii(t)) for i, t in rows), PII_NAMES)


def test_disclosing_terms_and_sanitising(spark, shared):
    rows = [(i, f"line {i} of filler words number {i * 7}\nplease ask Zoltan{'' if i % 2 else ','} via jo@ex.org about case {i}") for i in range(12)]
    rows += [(100 + i, f"other text {i} about filler and please and ask") for i in range(60)]
    rows += [(200, None), (201, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}
    assert out[200] is None and out[201] == ""
    assert "Zoltan" not in out[4] and "<EMAIL>" in out[4] and "jo@ex.org" not in out[4]
    assert out[103] == rows[15][1]


def test_copies_do_not_hide_disclosing_terms(spark, shared):
    rows = [(i, f"please ask Zoltan via jo@ex.org about case {'abc'[i]}") for i in range(3)]
    rows += [(100 + i, rows[0][1]) for i in range(2000)]  # copies of one
    rows += [(5000 + i, f"other text {i} about please and ask and via and case") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}
    assert all("Zoltan" not in out[i] and "<TERM>" not in out[i] for i in (0, 1, 2, 100))


def plain_figures(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    keys = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for k in keys:
        count[k] = count.get(k, 0) + 1
    covered = {j for i, k in enumerate(keys) if count[k] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed


def test_figures(docs):
    out = lines.judge_documents(docs)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same(out, [(i, *plain_figures(t)) for i, t, _ in texts_of(docs)], names)
    assert out.where("base_failed and kept").count() == 0


def test_line_frequency(spark, shared):
    import random

    draw = random.Random(5)
    body = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    menu = "Home | Products | About us today\nAll rights reserved 2024 by the owners of this page"
    rows = [(i, f"{menu}\n{body(80)}", "h1") for i in range(30)]  # boilerplate and own text
    rows += [(100 + i, f"{menu}\n" * 5 + body(2), "h1") for i in range(3)]  # hardly anything of its own
    copy = "\n".join(body(12) for _ in range(10))
    rows += [(200 + i, copy, "h1") for i in range(40)]  # copies of one document
    near = [copy.split(" ") for _ in range(40)]
    for i, w in enumerate(near):
        w[3 + i] = f"edit{i}"
    rows += [(300 + i, " ".join(w), "h2") for i, w in enumerate(near)]
    rows += [(400 + i, f"{menu}\n{body(60)}", None) for i in range(5)]  # too few on this host
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = {r["doc_id"]: r for r in lines.judge_documents(frame, rewrite=True).collect()}
    assert len(out) == len(rows)
    assert all(out[i]["kept"] and "Home" not in out[i]["text"] for i in range(30))
    assert not any(out[100 + i]["kept"] for i in range(3))
    assert all(out[200 + i]["kept"] and out[200 + i]["text"] == copy for i in range(40))
    assert all(out[300 + i]["kept"] for i in range(40))
    assert all(out[400 + i]["kept"] and "Home" in out[400 + i]["text"] for i in range(5))


def test_copies_and_repeats_leave_lines_frequent(spark, shared):
    import random

    draw = random.Random(6)
    body = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = [(i, "\n".join(f"{body(20)}\nReply" for _ in range(6)), "h1") for i in range(60)]  # six times in each document
    hot = f"Menu of the whole site\n{body(80)}"
    rows += [(100 + i, f"Menu of the whole site\n{body(80)}", "h2") for i in range(60)]
    rows += [(200 + i, hot, "h2") for i in range(400)]  # copies of one
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = lines.judge_documents(frame, rewrite=True).collect()
    assert not any("Reply" in r["text"] or "Menu" in r["text"] for r in out) and all(r["kept"] for r in out)


def test_shared_menus_leave_documents_different(spark, shared):
    import random

    draw = random.Random(7)
    body = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = []
    for host in range(8):
        menu = [body(8) for _ in range(6)]
        rows += [(100 * host + i, "\n".join([*menu, body(12)]), f"h{host}") for i in range(40)]
    copy = [body(12) for _ in range(60)]  # near copies, edited in many lines
    for i in range(60):
        own = list(copy)
        own[i] = own[i].replace(" ", " edit ", 1)
        rows.append((2000 + i, "\n".join(own), "near"))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = lines.judge_documents(frame, rewrite=True).collect()
    assert all(len(r["text"].split()) == 12 and not r["kept"] for r in out if r["doc_id"] < 2000)
    assert all(r["kept"] and r["text"].count("\n") == 59 for r in out if r["doc_id"] >= 2000)


def plain_verdicts(rows, limit=20):
    """doc_id: kept, by a loop over all documents; for lines of which none is an edited form of another."""
    hashed = lambda x: (xxhash.xxh64_intdigest(x, seed=42) + 2**63) % 2**64
    normal = lambda x: re.sub("[^a-z0-9]+", " ", re.sub("[0-9]+", "0", x.lower())).strip()
    split = {i: [(normal(x), len(x.split())) for x in t.split("\n") if x.split()] for i, t, _ in rows}
    versions = {(host, tuple(x for x, _ in split[i])): split[i] for i, _, host in rows}
    holders = {}
    for (host, key), _ in versions.items():
        for x in set(key):
            holders.setdefault((host, x), set()).add(key)
    often = {k for k, v in holders.items() if len(v) > limit}
    identity = {}
    for (host, key), each in versions.items():
        known = sum(n for x, n in each if (host, x) in often)
        own = frozenset(x for x in key if (host, x) not in often)
        least = min((x for x in key if (host, x) in often), key=hashed, default=None)
        identity[host, key] = key if 2 * known < sum(n for _, n in each) else own or least
    frequent = {k for k in often if len({identity[k[0], key] for key in holders[k]}) > limit}
    kept = {}
    for i, t, host in rows:
        taken, words = sum(n for x, n in split[i] if (host, x) in frequent), sum(n for _, n in split[i])
        left = words - taken
        kept[i] = not plain_figures(t)[-1] and not (taken and (left < 20 or left / words < 0.2))
    return kept


def test_verdicts(spark, shared):
    draw = random.Random(11)
    body = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    pool = {h: [body(draw.randrange(5, 20)) for _ in range(12)] for h in ("h1", "h2", "h3")}
    rare = [body(10) for _ in range(30)]
    rows = []
    for i in range(600):
        host = draw.choice(list(pool))
        each = draw.sample(pool[host], draw.randrange(0, 9)) + draw.sample(rare, draw.randrange(0, 3))
        each += [body(draw.randrange(5, 40)) for _ in range(draw.randrange(0, 4))]
        draw.shuffle(each)
        rows += [(10 * i + k, "\n".join(each), host) for k in range(draw.choice([1, 1, 1, 5]))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = {r["doc_id"]: r["kept"] for r in lines.judge_documents(frame).collect()}
    want = plain_verdicts(rows)
    assert out == want and 100 < sum(want.values()) < len(want) - 100
    depleted = [i for i, t, _ in rows if not want[i] and not plain_figures(t)[-1]]
    assert len(depleted) > 50


def test_licenses(spark, shared, docs, empty):
    mit = licenses.KNOWN[0][1]
    british = mit.upper()
    rows = [
        (1, "Copyright (c) 2020 Jane Doe\nAll rights reserved.\n\n" + british, ["MIT"], "MIT"),
        (2, mit + " And more.", [], None),
        (3, "Some text.\n  licenced under the APACHE licence; version 2.0!\nmore", ["Apache-2.0"], None),
        (4, None, [], None), (5, "", [], None), (6, "...", [], None),
        (7, "Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], "CC-BY-NC-4.0"),
        (7, "Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"], "CC-BY-NC-4.0"),
        (8, "MIT License\n\nCopyright (c) Acme Inc.\n\n" + mit, ["MIT"], "MIT"),
        (9, "The MIT License (MIT)\nCopyright Jane Doe\n" + mit.replace(". ", ".\n"), ["MIT"], "MIT"),
        (10, "Copyright holders only", [], None),
        *[(20 + i, t.replace(", ", ",\n  * "), [x], x) for i, (x, t) in enumerate(licenses.KNOWN) if len(t) > 600],
    ]
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    out = licenses.scan_licenses(frame, licenses.known_digests(spark))
    assert sorted((r["doc_id"], r["notice_ids"], r["license_id"]) for r in out.collect()) == sorted((r[0], r[2], r[3]) for r in rows)
    assert licenses.scan_licenses(docs, licenses.known_digests(spark)).count() == docs.count()


def plain_digests(t):
    """Digest of the text and digests of its lines, by a loop over words."""
    words, canon = dict(licenses.EQUIVALENT), []
    pairs = {tuple(a.split()): b.split() for a, b in licenses.EQUIVALENT_PAIRS}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def joined(each):
        out, i = [], 0
        while i < len(each):
            hit = pairs.get(tuple(each[i : i + 2]))
            out += hit or [each[i]]
            i += 2 if hit else 1
        return " ".join(out)

    for line in t.lower().split("\n"):
        if not regex.match(licenses.COPYRIGHT_LINE, line):
            each = regex.findall(r"[\p{L}\p{N}]+", line)
            canon.append([y for x in each for y in words.get(x, x).split()])
    canon = [x for x in canon if x]
    first = next((i for i, x in enumerate(canon) if x[0] != "copyright" and " ".join(x) not in licenses.TITLES), 0)
    whole = joined([w for x in canon[first:] for w in x])
    return (sha(whole) if whole else None), {sha(joined(x)) for x in canon}


def test_license_digests(spark, shared, docs):
    draw = random.Random(3)
    names = [a for a, _ in licenses.EQUIVALENT] + ["copyright holder", "sub license", "license license", "copyright", "x", "by", "(c)", "©", "2020"]
    rows = [(i, "".join(draw.choice(names) + draw.choice([" ", " ", "-", "\n", ", "]) for _ in range(draw.randrange(40)))) for i in range(300)]
    rows += [(1000 + i, t) for i, (_, t, _) in enumerate(texts_of(docs)) if t.isascii()]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r["doc_id"]: (r["text_digest"], set(r["line_digests"])) for r in licenses.with_digests(frame, "text").collect()}
    assert out == {i: plain_digests(t) for i, t in rows}


@pytest.mark.parametrize("scan", [
    lambda d, s: licenses.scan_licenses(d, licenses.known_digests(s)), lambda d, s: pii.find_personal_data(d), lambda d, s: pii.sanitise(d),
    lambda d, s: secrets.scan_secrets(d, VOCABULARY, public_tokenizers.PATTERN), lambda d, s: tokens.count_tokens(d, BPE),
    lambda d, s: lines.judge_documents(d, rewrite=True),
])
def test_no_rows(spark, shared, empty, scan):
    assert scan(empty, spark).count() == 0
