"""Operators over the whole corpus (2, 5, 6, 8, 10) and the pipeline, against plain versions."""

import hashlib
import math
import gc
import os
import random
import re
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import same
from postsieve.llm import lines, lm, mixing, near, phrases, warc
from postsieve.llm.common import forget
from postsieve.llm.components import components
from postsieve.llm.hashing import PLAIN, word_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def pages(spark, shared):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()][:60]
    big, small = "<p>é\r\n\r\nWARC/1.1\r\n" * 90, "<p>tiny\r\n\r\n"
    rows += [(1000 + i, f"http://h/{i} x\r\ny", big) for i in range(25)]
    rows += [(2000 + i, None, small) for i in range(3)] + [(3000, "u", None), (3001, "", ""), (1003, "http://h/3 x\r\ny", big), (1024, "again", big)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_warc(spark, pages):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    head = {}
    for i, p in rows:
        if len(p) >= 1000:
            head[p] = max(head.get(p, i), i)
    want = []
    for i, p in rows:
        again = p in head and head[p] != i
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", head[p] if again else None))
    out = warc.page_rows(warc.round_trip(spark, pages))
    same(out, want, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    assert warc.round_trip(spark, pages.where("false")).count() == 0


def test_warc_payloads_and_lost_partners(spark, shared, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(warc.with_originals(pages), path, captures_per_file=7)
    records = warc.read_warc(spark, path).persist()
    payloads = Counter(bytes(r["payload"]).decode() for r in records.where("record_type = 'response'").collect())
    assert payloads == Counter(r["payload"] for r in warc.with_originals(pages).where("original_id is null").collect())
    gone = records.where("record_type <> 'response' or target_uri not like '%tionsh%'")
    captures = warc.assemble(gone)
    assert captures.count() == pages.count()
    lost = records.where("record_type = 'response' and target_uri like '%tionsh%'").count()
    assert captures.where("response is null and request is not null and metadata is not null").count() == lost


def test_warc_cut_archive():
    import zlib as z

    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    gz = lambda b: (c := z.compressobj(wbits=31)).compress(b) + c.flush()
    for content in (record * 2, gz(record * 2), gz(record) + gz(record)):
        assert [b for _, b in warc.parse_records(content)] == [b"ab\r\n"] * 2
    with pytest.raises(ValueError):
        list(warc.parse_records(record[:-8]))


def test_mix(docs):
    rows = [(r["doc_id"], len(WORD.findall(r["text"] or "")), r["source"]) for r in docs.collect()]
    sizes = defaultdict(int)
    for _, n, s in rows:
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    plan = mixing.plan_mix(docs).select("doc_id", "size", "source_size", "source", "target", "taken", "positions").collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in plan) == sorted((str(i), n) for i, n, _ in rows)
    taken = defaultdict(int)
    for r in plan:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and len(r["positions"]) == math.ceil(r["taken"] / r["size"] if r["size"] else 0)
        assert r["positions"] == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mixing.plan_mix(docs.repartition(3)).select("doc_id", "taken", "positions").collect()
    assert sorted(map(str, again)) == sorted(str(x) for x in mixing.plan_mix(docs).select("doc_id", "taken", "positions").collect())
    assert mixing.plan_mix(docs.where("false")).count() == 0


def test_positions_invert_the_schedule(spark):
    frame = spark.range(0, 101).selectExpr("id / 100.0D as u", "cast(id % 3 as int) as turn")
    out = frame.select("u", "turn", mixing.time_of(frame["u"], mixing._schedule_columns(frame["turn"], mixing.SCHEDULES)).alias("t"))
    for r in out.collect():
        knots = mixing.SCHEDULES[r["turn"]]
        x = np.linspace(0, 1, 20001)
        w = np.interp(x, [k[0] for k in knots], [k[1] for k in knots])
        area = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2)))
        assert np.interp(r["t"], x, area / area[-1]) == pytest.approx(r["u"], abs=1e-4)


def kmers(text):
    h, at = word_hashes([text], PLAIN)
    return near.labelled_kmers(h, at)[0]


def plain_similarity(a, b):
    """Longest common subsequence over all k-mers, without a band."""
    a, b = kmers(a).tolist(), kmers(b).tolist()
    last = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[-1], last[j + 1]))
        last = row
    return last[-1] / (len(a) + len(b) - last[-1]) if a or b else 0.0


def near_fixture():
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    texts = []
    for g in range(12):
        base = [word() for _ in range(draw.choice((6, 12, 60, 150, 400)))]
        for c in range(6):
            own = list(base)
            for _ in range(int(len(base) * draw.choice((0, 0.005, 0.01, 0.02, 0.05)))):
                own[draw.randrange(len(own))] = word()
            if c == 5:
                own = own[len(own) // 2 :] + own[: len(own) // 2]
            texts.append(" ".join(own))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(80)) for _ in range(20)]
    texts += ["", "", "...", "one two", "one two", "One, two!", "a b c d e f", None, None]
    return texts


def test_near_duplicates(spark, shared):
    texts = near_fixture()
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(texts):
        for j in range(i):
            b = texts[j]
            if a is not None and b is not None and (a == b or plain_similarity(a, b) >= 0.8):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in near.near_duplicates(frame).collect()}
    assert [out[i]["class_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert all(out[i]["is_first"] == (find(i) == i) for i in range(len(texts)))


def test_near_chains_of_versions(spark, shared):
    draw = random.Random(21)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))

    def edited(words, n):
        own = list(words)
        for at in draw.sample(range(len(own)), n):
            own[at] = word()
        return own

    base = [word() for _ in range(200)]
    versions = [edited(base, 2) for _ in range(100)]
    versions += [edited(v, 4) for v in versions]  # near their own version, and mostly no other
    texts = {f"{i:03}": " ".join(v) for i, v in enumerate(versions)}
    frame = spark.createDataFrame(list(texts.items()), "text_id string, body string")
    marks = {i: near.sketches(kmers(t)) for i, t in texts.items()}
    labelled = {i: kmers(t) for i, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b and (marks[a] == marks[b]).any()]
    pairs = [p for p in pairs if near.aligned(labelled[p[0]], labelled[p[1]], 0.8) >= 0.8]
    root = {r["node"]: r["root"] for r in components(near.near_links(frame)).collect()}
    assert pairs and all(root.get(a, a) == root.get(b, b) for a, b in pairs)


def test_counts_rule_out_only_other_texts():
    draw = random.Random(22)
    for _ in range(300):
        base = [draw.choice("abcdefghijklmnop") * 2 for _ in range(draw.randrange(5, 300))]
        other = list(base)
        for _ in range(draw.randrange(6)):
            other[draw.randrange(len(other))] = "new"
        a, b = kmers(" ".join(base)), kmers(" ".join(other))
        cells = [near.cells_of(x)[None, :] for x in (a, b)]
        if near.aligned(a, b, 0.8) >= 0.8:
            assert near.possible(cells[0], np.array([len(a)]), cells[1], np.array([len(b)]), 0.8)[0, 0]


def test_near_duplicates_of_edge_rows(docs):
    out = near.near_duplicates(docs)
    assert out.count() == docs.count() and "spans" in out.columns
    assert near.near_duplicates(docs.where("false")).count() == 0


def test_aligned_is_the_band_free_value():
    draw = random.Random(4)
    for _ in range(300):
        base = [draw.choice("abcdefghijklmnop") * 3 for _ in range(draw.randrange(1, 70))]
        other = list(base)
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(other) + 1)
            draw.choice((lambda: other.insert(at, "new"), lambda: other.__delitem__(slice(at, at + 2))))()
        a, b = " ".join(base), " ".join(other)
        want = plain_similarity(a, b)
        got = near.aligned(kmers(a), kmers(b), 0.8)
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_components(spark, shared):
    draw = random.Random(9)
    links = [(f"{i:04}", f"{i + 1:04}") for i in range(300) if i % 50] + [("star", f"s{i:03}") for i in range(200)] + [("x", "x")]
    draw.shuffle(links)
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert all(out[f"{i:04}"] == f"{(i - 1) // 50 * 50 + 1:04}" for i in range(1, 300) if (i - 1) % 50)
    assert all(out[n] == "s000" for n in ["star", *(f"s{i:03}" for i in range(1, 200))])


def test_scores(docs):
    rows = [(r["doc_id"], lowered(r["text"])) for r in docs.collect()]
    part = lambda i: zlib.crc32(str(i).encode()) % 5 if i is not None else 0
    tokens = lambda t: [*WORD.findall(t), None]
    count = Counter(w for i, t in rows if part(i) != 1 for w in tokens(t))
    total, v = sum(count.values()), len(count)
    out = lm.score_documents(docs).collect()
    assert len(out) == len(rows)
    want = {}
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (v + 1))) for w in own)
        want[(i, len(own))] = (part(i) == 1, sum(count[w] > 0 for w in own), base)
    gain = 0.0
    for r in out:
        held_out, known, base = want[(r["doc_id"], r["n_tokens"])]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (held_out, known, total)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] < 0
        gain += (r["score"] - r["base_score"]) * held_out
    assert gain > 0  # held-out accuracy: better than the unigram score


def test_scores_against_plain_mixture(spark, shared):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice(("red fox", "old dog", "the the", "A b", f"w{draw.randrange(40)}")) for _ in range(12))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(frame).collect()}
    part = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    tokens = {i: [*WORD.findall(lowered(t)), "<end>"] for i, t in rows}
    train = [i for i in tokens if part[i] != 1]
    words = Counter(w for i in train for w in tokens[i])
    fit_words = Counter(w for i in train if part[i] != 4 for w in tokens[i])
    total, n_fit, v = sum(words.values()), sum(fit_words.values()), len(words)
    assert all(n * lm.TOP >= total for n in words.values())  # every word is a context of its own here
    classes = {w: w for w in words}
    other = lambda w: classes.get(w, ("ending", w[-2:]))
    pair_of = lambda i: list(zip([None, *map(other, tokens[i][:-1])], tokens[i]))
    pairs = Counter(p for i in train for p in pair_of(i))
    fit = Counter(p for i in train if part[i] != 4 for p in pair_of(i))
    left = Counter(p for i in train if part[i] == 4 for p in pair_of(i))
    ctx, ctx_fit = Counter(), Counter()
    for (c, _), n in pairs.items():
        ctx[c] += n
    for (c, _), n in fit.items():
        ctx_fit[c] += n
    bucket = lambda n: int(math.log2(n + 1))
    weights = defaultdict(lambda: np.array([0.4, 0.5, 0.1]))
    for _ in range(lm.ROUNDS):
        sums = defaultdict(lambda: np.zeros(3))
        for (c, w), n in left.items():
            p = weights[bucket(ctx_fit[c])] * [fit[c, w] / max(ctx_fit[c], 1), fit_words[w] / n_fit, 1 / (v + 1)]
            sums[bucket(ctx_fit[c])] += n * p / p.sum()
        moved = 0.0
        for b, s in sums.items():
            fresh = np.maximum(np.maximum(s, 1e-9) / np.maximum(s, 1e-9).sum(), 1e-6)
            fresh /= fresh.sum()
            moved = max(moved, np.abs(fresh - weights[b]).max())
            weights[b] = fresh
        if moved < lm.FINE:
            break
    for i in tokens:
        want = 0.0
        for c, w in pair_of(i):
            want += math.log10(weights[bucket(ctx[c])] @ [pairs[c, w] / max(ctx[c], 1), words[w] / total, 1 / (v + 1)])
        assert got[i] == pytest.approx(want), i


def plain_leaks(docs, items):
    terms = [(str(i), TERM.findall(lowered(t))) for i, t in items]
    windows = defaultdict(set)
    for i, w in terms:
        n = min(10, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[a : a + n])].add(i)
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = TERM.findall(lowered(t))
        hit, ids = set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if found := windows.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    ids |= found
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


LEAK_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_leaks(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, "one"), (901, None), (902, ""), (903, "after ME repeat"), (904, "x y x y x y x y x y x y"), (905, "...")]
    items += [(905, "b c d"), (906, items[3][1]), (907, "q " * 30), (908, "Straße 😀")]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    out = phrases.decontaminate(docs, frame)
    same(out, plain_leaks([(r["doc_id"], r["text"]) for r in docs.collect()], items), LEAK_NAMES)
    assert phrases.decontaminate(docs.where("false"), frame).count() == 0
    assert phrases.decontaminate(docs, frame.where("false")).where("contaminated").count() == 0


def test_proximity(spark, shared):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, item), (2, item.replace("delta", "delta new words")), (3, "alpha only here"), (4, "mu lambda kappa")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    out = {r["doc_id"]: r for r in phrases.decontaminate(frame, items).collect()}
    assert out[1]["contaminated"] and not out[2]["contaminated"]
    assert out[1]["n_near"] == 0 and out[3]["n_near"] == 0


def test_pipeline(spark, shared):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, SF)
    texts = {(r["doc_id"], r["text"]) for r in out.collect()}
    assert len({i for i, _ in texts}) == len(texts) and {i for i, _ in texts} <= {r["doc_id"] for r in rows.collect()}
    assert not any(x[-1] for x in plain_leaks(texts, items))
    assert not any("@mail" in t for _, t in texts)
    positions = [r["position"] for r in out.collect()]
    assert len(positions) > len(texts)
    sums = out.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 1 for r in sums)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows.where("false"), SF).columns == rows.columns, name


def test_rare_words_are_contexts_of_their_own(spark, shared):
    """Two words that are rare among many tokens, and have the same last letters, lead to different words."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(120))) for i in range(300)]
    rows += [(1000 + i, "oneing left" if i % 2 else "twoing right") for i in range(8)]
    rows += [(2000 + i, t) for i, t in enumerate(["oneing left", "oneing right", "twoing right", "twoing left"])]
    got = {r["doc_id"]: r["score"] for r in lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(got) == len(rows)
    assert got[2000] > got[2001] + 0.05 and got[2002] > got[2003] + 0.05


def test_near_links_delete_what_is_read(spark, shared):
    rows = [(str(i), " ".join(f"w{i % 3}x{j}" for j in range(30)) + (" end" if i % 2 else "")) for i in range(6)]
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    near.near_links(spark.createDataFrame(rows, "text_id string, body string")).collect()
    left = [name.rsplit("-", 1)[0] for name in set(os.listdir(base)) - before]
    assert not {"sketches", "shared", "groups", "placed"} & set(left)


def test_stages_leave_only_their_result(spark, shared):
    """A stage deletes what it stored before its result is read, also where nobody disposes of it."""
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    base = spark.conf.get("spark.checkpoint.dir")
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_dedup, corpus_pipeline.decontamination):
        before = set(os.listdir(base)) if os.path.isdir(base) else set()
        out = stage(spark, rows, SF)
        left = set(os.listdir(base)) - before
        assert {name.rsplit("-", 1)[0] for name in left} <= {"judged", "first", "leaks"}, stage
        assert out.count() <= rows.count()
    plan = corpus_pipeline.near_dedup(spark, rows, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line and "Reused" not in line for line in plan.splitlines()) == 2


def test_components_leave_only_their_last_round(spark, shared):
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    rows = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(40)], "a string, b string")
    assert components(rows).count() == 40
    assert len(set(os.listdir(base)) - before) == 1


def test_near_links_leave_only_the_links(spark, shared):
    rows = [(str(i), " ".join(f"w{i % 3}x{j}" for j in range(30)) + (" end" if i % 2 else "")) for i in range(6)]
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    assert near.near_links(spark.createDataFrame(rows, "text_id string, body string")).count() > 0
    assert {name.rsplit("-", 1)[0] for name in set(os.listdir(base)) - before} == {"links"}
    assert len(set(os.listdir(base)) - before) == 1


def test_stages_store_no_texts(spark, shared):
    """What quality rules and personal data leave behind, for as long as the pipeline runs, has no texts in it."""
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    base = spark.conf.get("spark.checkpoint.dir")
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.personal_data):
        before = set(os.listdir(base)) if os.path.isdir(base) else set()
        out = stage(spark, rows, SF)
        for name in set(os.listdir(base)) - before:
            assert not {"text", "l", "body"} & set(spark.read.parquet(f"{base}/{name}").columns), name
        assert out.count() <= rows.count()


def test_quality_rules_rewrite_as_the_operator_does(spark, shared):
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:06}")
    rows = [(i, "\n".join(["common menu line of the host", *(f"{word(1000 * i + j)} and others" for j in range(40))]), "h") for i in range(60)]
    rows += [(5, rows[5][1], "h"), (900, None, "h"), (901, "too short", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = lines.judge_documents(frame, rewrite=True).where("kept").select("doc_id", "text", "source").collect()
    assert any("common menu" not in r["text"] for r in want)
    got = corpus_pipeline.quality_rules(spark, frame.withColumn("n_chars", F.lit(0).cast("long")), SF)
    same(got, [tuple(r) for r in want], ("doc_id", "text", "source"))


def test_components_of_stars_need_no_round(spark, shared, monkeypatch):
    """near_links looks for components once, and links that are stars already are what components leave."""
    from postsieve.llm import components as module

    rounds, searches = [], []
    star, search = module._star, near.components
    monkeypatch.setattr(module, "_star", lambda *a: (rounds.append(1), star(*a))[1])
    monkeypatch.setattr(near, "components", lambda links: (searches.append(1), search(links))[1])
    stars = spark.createDataFrame([("a", "b"), ("c", "a"), ("x", "y"), ("a", "b"), ("z", "z")], "a string, b string")
    assert {(r["node"], r["root"]) for r in components(stars.where("a <> 'c'")).collect()} == {("b", "a"), ("y", "x")} and not rounds
    assert {(r["node"], r["root"]) for r in components(stars).collect()} == {("b", "a"), ("c", "a"), ("y", "x")}
    rows = [(str(i), " ".join(f"w{i % 3}x{j}" for j in range(30)) + (" end" if i % 2 else "")) for i in range(6)]
    near.near_links(spark.createDataFrame(rows, "text_id string, body string")).collect()
    assert len(searches) == 1


def test_forget_lets_go_of_plans(spark, shared):
    """Handles of plans are in reference cycles: without Python's collector, plans and their shuffle files stay."""
    gc.disable()
    try:
        rows = spark.range(10).groupBy("id").count()
        rows.collect()
        plan = weakref.ref(rows._jdf)
        del rows
        forget(spark)
        assert plan() is None
    finally:
        gc.enable()


def test_pairs_are_shuffled_in_turns(spark, shared):
    """Each shuffle of pairs holds the groups of one turn, and nothing but the tables of the result stays."""
    rows = spark.createDataFrame([(0, " ".join(f"w{i * j % 50}" for j in range(30))) for i in range(40)], "part int, text string")
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    starts = np.array([40])
    got = lm.pair_counts(rows, np.array([lm.START]), starts, starts, 40 * 31, 12)
    assert len(got) == lm.TURNS > 1
    for turn, counts in enumerate(got):
        assert {r["bucket"] % lm.TURNS for r in counts.where(F.col("kind") == lm.GROUP).collect()} == {turn}
    assert len(set(os.listdir(base)) - before) == lm.TURNS
