"""Very long, very frequent and repeated inputs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rxlink.llm import secrets_scan
from tests.llm.test_operators import DOCS, added_by_hand, base_by_hand

# --- 5: secrets


def long_texts(n):
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    made = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    return {
        "path": "/".join(f"dir{i % 7}" for i in range(n // 5)), "slashes": "/" * n, "letters": "abcdefghij" * (n // 10), "camel": "AbcDef" * (n // 6), "words": "Some_long_identifier_of_words" * (n // 29),
        "one": "x" * n, "unit": "ab3" * (n // 3), "digits": "0123456789" * (n // 10), "late": "z" * (n - 60) + made(60), "hex": " ".join("%016x" % rng.getrandbits(64) for _ in range(n // 17)),
        "mixed": " ".join(("%016x " % rng.getrandbits(64)) + made(24) for _ in range(n // 42)), "assigned": " ".join(f"password={made(14)}" for _ in range(n // 24)),
    }


@pytest.mark.parametrize("size", [10_000, 100_000, 1_000_000])
def test_secrets_in_long_texts(spark, size):
    texts = long_texts(size)
    df = spark.createDataFrame(list(enumerate(texts.values())), DOCS).repartition(8)
    out = secrets_scan.scan_secrets(df).select("doc_id", secrets_scan.spelled(F.col("__ss_base")), F.size("__ss_base"), F.size("__ss_spans"))
    for doc, base, n, every in out.collect():
        want = base_by_hand(list(texts.values())[doc])
        assert n == len(want) and base == ",".join(want)
        if size == 10_000:
            assert every == n + len(added_by_hand(list(texts.values())[doc]))
        assert list(texts)[doc] in ("late", "mixed", "assigned") or every == n
        assert list(texts)[doc] != "late" or every == n + 1


def test_entropy_across_pieces(spark):
    rng = random.Random(9)
    from tests.llm.test_operators import window_entropy

    rows = ["ab" * k + "".join(rng.choice("XYZ0189+/cdefgh") for _ in range(25)) + "ab" * 2500 for k in (0, 2030, 2038, 2044, 2048, 2055)]
    got = spark.createDataFrame([(w,) for w in rows], "c string").select("c", secrets_scan.best_entropy(F.col("c"))).collect()
    assert Counter(round(r[1], 9) for r in got) == Counter(round(window_entropy(w), 9) for w in rows)


# --- 10: packing


@pytest.mark.parametrize("most", [1, 3, 20])
def test_packing_with_few_open_windows(most):
    import numpy as np

    from rxlink.llm import packing

    rng = random.Random(most)
    p = packing.Packer(64, max_open=most)
    sizes = [rng.choice([1, 2, 3, 40, 63, 64, 65, 200]) for _ in range(500)]
    for doc, n in enumerate(sizes):
        p.add(doc, np.arange(n, dtype=np.uint32))
        assert p.open <= most and p.open == sum(map(len, p.levels)) and [len(x) for x in p.levels] == p.counts.tolist()
    p.finish()
    pieces, fill = Counter(), Counter()
    for doc, start, length, _, total, window, offset in sorted(p.out, key=lambda r: (r[0], r[1])):
        assert start == pieces[doc] and total == sizes[doc]
        pieces[doc] += length
    for *_, length, _, _, window, offset in sorted(p.out, key=lambda r: (r[5], r[6])):
        assert offset == fill[window]
        fill[window] += length
    assert pieces == Counter(dict(enumerate(sizes))) and all(n == 64 or n & (n - 1) == 0 for n in fill.values())
    assert sum(n < 64 for n in fill.values()) <= 6  # the last window's powers of two alone


# --- 3: near dedup


def test_near_dedup_of_repeated_ids(spark):
    from rxlink.llm import near_dedup
    from tests.llm.test_operators import near_by_hand, near_group

    a, other = near_group(1, 41)[0], "nothing like the others at all , really nothing"
    near = f"{a} tail"
    rows = [(5, a), (5, other), (3, near), (3, None), (5, a), (7, ""), (None, a), (9, other + " x y"), (4, near_group(1, 42)[0]), (2, near_group(1, 42)[0])]
    df = spark.createDataFrame(rows, DOCS)
    assert Counter(tuple(r) for r in near_dedup.near_duplicates(df).collect()) == near_by_hand(rows)
    kept = Counter(tuple(r) for r in near_dedup.keep_one(df).collect())
    assert (5, other) in kept and (5, a) not in kept and (3, near) in kept
    assert sum(kept.values()) == sum(v for k, v in near_by_hand(rows).items() if k[3] or k[0] is None)


def test_components_of_chains_and_stars(spark, monkeypatch):
    from rxlink.llm import graph

    rng = random.Random(4)
    links = [(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2050, 2000 + i) for i in range(50)] + [(rng.randrange(3000, 3300), rng.randrange(3000, 3300)) for _ in range(150)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for u, v in links:
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    want = {i: root(i) for i in {x for p in links if p[0] != p[1] for x in p}}
    rounds = []
    monkeypatch.setattr(graph, "written", lambda df, name, w=graph.written: rounds.append(name) or w(df, name))
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(links, "u long, v long"), "test").collect())
    assert got == want
    assert sum(n.endswith("-left") for n in rounds) <= 10


# --- 7: embeddings


def test_embeddings_over_many_cells_and_chunks(spark, monkeypatch):
    import numpy as np

    from rxlink.llm import embed_dedup

    monkeypatch.setattr(embed_dedup, "CELL", 20)
    monkeypatch.setattr(embed_dedup, "CHUNK_VALUES", 1)  # chunks of 64 homes and 256 probes
    rng = np.random.default_rng(8)
    base = rng.normal(size=(500, 40))
    v = np.concatenate([base, base[:200] + rng.normal(size=(200, 40)) * 0.2, base[0] + rng.normal(size=(400, 40)) * 0.18, base[:50] * 3])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(v))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(v)).min(axis=1))
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_vectors(df).collect()}
    assert got == {i: (int(link[i].sum()), int(label[i])) for i in range(len(v))}


def test_cells_reached_hold_all_near_vectors():
    import numpy as np

    from rxlink.llm import embed_dedup

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)) / 8
    home, mask = embed_dedup.reached(x, x[:60], 0.3)
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.09
    for i, j in zip(*np.nonzero(near)):
        assert mask[i, home[j]] or mask[j, home[i]]
    assert mask.mean() < 0.5


# --- 2: toxicity


def features_by_hand(text, learnt):
    import math
    import re

    from rxlink.llm import toxicity as t

    tokens = text.split()
    if not tokens:
        return dict.fromkeys(t.FEATURES, 0.0)
    known = lambda w: (w in t.INSULTS, f"={w}" in learnt and len(w) >= 3 or any(len(w) >= n and f"{w[:n]}*" in learnt for n in (4, 5, 6)))
    fixed, learnt_hits, undone_hits, second, capitals, mixed_n, drawn_n, hits = 0, 0, 0, [], 0, 0, 0, []
    for i, token in enumerate(tokens):
        core = token.strip(t._EDGE)
        word = core.lower()
        a, b = known(word)
        mixed = any(c.isalpha() for c in core) and any(c.isdigit() or c in "@$!*#%_|+" for c in core)
        drawn = any(x == y == z and (x.isalnum() or x == "_") for x, y, z in zip(core, core[1:], core[2:]))
        if not (a or b) and (mixed or drawn):
            swapped = "".join("oieastasiit"["013457@$!|+".index(c)] if c in "013457@$!|+" else c for c in token.lower())
            bare = "".join(c for c in swapped if c.isalnum())
            a, b = known(re.sub(r"(.)\1{2,}", r"\1", bare))
            undone_hits += a or b
        fixed, learnt_hits = fixed + a, learnt_hits + b
        hits += [i] if a or b else []
        second += [i] if word in t.SECOND else []
        capitals += len(core) > 1 and core.isupper()
        mixed_n, drawn_n = mixed_n + mixed, drawn_n + drawn
    n, size = len(tokens), len(text)
    gaps = [min(abs(h - s) for s in second) for h in hits] if second else []
    upper, lower = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    marks = sum("!" <= c <= "~" and not (c.isascii() and c.isalnum()) for c in text)
    return {
        "fixed_density": fixed / n, "fixed_count": math.log1p(fixed), "learnt_density": learnt_hits / n, "learnt_count": math.log1p(learnt_hits), "hit_density": len(hits) / n, "obfuscated_hits": undone_hits,
        "second_density": len(second) / n, "second_nearness": 1 / (1 + min(gaps)) if gaps else 0, "second_share": sum(g <= 5 for g in gaps) / len(gaps) if gaps else 0, "capital_rate": upper / max(1, upper + lower),
        "capital_words": capitals / n, "exclamation_rate": text.count("!") / size, "question_rate": text.count("?") / size, "punctuation_rate": marks / size, "digit_rate": sum("0" <= c <= "9" for c in text) / size,
        "mixed_rate": mixed_n / n, "drawn_out_rate": drawn_n / n, "log_tokens": math.log1p(n), "token_length": size / n,
    }


def test_toxicity_features():
    from rxlink.llm import toxicity as t
    from tests.llm.test_operators import table

    learnt = frozenset({"=word", "stem*", "longer*"})
    texts = ["", "  ", "You are an 1d10t, YOU st*pid!! fooool?", "word words stemming longerish WORD's you", "a " * 8 + "you " + "b " * 5 + "idiot", "«Idiot» ... b4d w0rd xXx aaa 100%", *(r["text"] for r in table("documents")[:300] if r["text"])]
    for text in texts:
        got = dict(zip(t.FEATURES, t.features(text, t.Flags(learnt))))
        assert got == pytest.approx(features_by_hand(text, learnt), abs=1e-12), text[:80]


def test_toxicity_trees_take_the_best_cuts():
    import numpy as np

    from rxlink.llm.toxicity import Trees

    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = (x[:, 1] + 0.3 * rng.normal(size=200) > 0.2).astype(float)
    t = Trees(depth=2, rounds=3, bins=16).fit(x, y)
    raw = np.full(200, t.base)
    for feature, cut, leaf in t.trees:
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        b = np.stack([(x[:, [i]] >= c[None, :]).sum(axis=1) for i, c in enumerate(t.cuts)], axis=1)

        def gain(rows, i, k):
            sides = [rows & (b[:, i] <= k), rows & (b[:, i] > k)]
            if min(s.sum() for s in sides) < t.least:  # noqa: B023
                return 0.0
            return sum(g[s].sum() ** 2 / (h[s].sum() + t.l2) for s in sides) - g[rows].sum() ** 2 / (h[rows].sum() + t.l2)  # noqa: B023

        at = np.zeros(200, dtype=int)
        for _ in range(2):
            for node in set(at.tolist()):
                rows = at == node
                best = max(gain(rows, i, k) for i in range(3) for k in range(17))
                own = gain(rows, feature[node], cut[node])
                assert own == pytest.approx(best, abs=1e-9) or best < 1e-8
            at = 2 * at + 1 + (b[np.arange(200), feature[at]] > cut[at])
        for node in set(at.tolist()):
            rows = at == node
            assert leaf[node - 3] == pytest.approx(-t.rate * g[rows].sum() / (h[rows].sum() + t.l2))
        raw += leaf[at - 3]
    assert t.raw(x) == pytest.approx(raw)


def test_toxicity_on_held_out_rows(spark):
    import pyarrow.dataset as ds

    from rxlink.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    labels = dict(zip(*(ds.dataset(f"{sf}/labels.parquet").to_table()[c].to_pylist() for c in ("doc_id", "toxic"))))
    got = [(r.predicted, labels[r.doc_id]) for r in QUERIES["op2_toxicity"](spark, sf).collect() if r.held_out and labels.get(r.doc_id) is not None]
    toxic, clean = [p for p, t in got if t == 1], [p for p, t in got if t == 0]
    assert sum(toxic) / len(toxic) >= 0.7 and sum(clean) / len(clean) <= 0.02


# --- 4: WARC


def plain_archive(n, size):
    from rxlink.llm import warc

    rng = random.Random(2)
    return [warc.render(i, f"http://h/{i}", rng.randbytes(rng.randrange(1, size)), None, False) for i in range(n)]


def test_warc_damaged_length_takes_linear_time():
    import io
    import re
    import time

    from rxlink.llm import warc

    records = plain_archive(6000, 8000)
    whole = b"".join(records)

    def run(data):
        began = time.perf_counter()
        ends = lambda n: n <= len(data) and data[n - 4 : n] == b"\r\n\r\n"
        both = [[r | {"reason": None} for r in warc.salvage(io.BytesIO(data).read, e)] for e in (None, ends)]
        assert both[0] == both[1]
        return both[0], time.perf_counter() - began

    clean, usual = run(whole)
    assert len(clean) == 6000
    for bad in (3, 2000, 5990):
        records[bad] = re.sub(rb"Content-Length: (\d+)", rb"Content-Length: 9\1", records[bad]) if bad != 3 else re.sub(rb"Content-Length: \d+", b"Content-Length: 99999999999", records[bad])
    rows, took = run(b"".join(records))
    assert [r["page_id"] for r in rows if "gap_start" not in r] == [i for i in range(6000) if i not in (3, 2000, 5990)]
    assert sum("gap_start" in r for r in rows) == 3
    assert took < 3 * usual + 1


def test_warc_long_headers_and_inflating_members():
    import io
    import zlib

    from rxlink.llm import warc

    one = warc.render(1, "http://h/" + "x" * 300_000, b"body", None, False)
    nested = warc.render(2, "http://h/2", one, None, False)
    assert [r["page_id"] for r in warc.salvage(io.BytesIO(one + nested).read)] == [1, 2]
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    bomb = z.compress(one + b"\0" * 300_000_000) + z.flush()
    rows = list(warc.salvage(io.BytesIO(bomb + one).read))
    assert [r.get("reason") for r in rows] == ["content length does not fit", None]


@pytest.mark.parametrize("copies", [3, 10_000])
def test_warc_frequent_payloads(spark, monkeypatch, copies):
    from rxlink.llm import warc

    monkeypatch.setattr(warc, "COPIES", copies)
    rows = [(i, f"u{i}", "same page") for i in range(50)] + [(100 + i, f"v{i}", f"own {i}") for i in range(20)] + [(200, "a", "twice"), (201, "b", "twice"), (300, None, None), (301, "c", "")]
    got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    last = {(t or ""): i for i, _, t in rows}
    want = Counter((i, len(t or ""), warc.sha1_base32((t or "").encode()), "response" if last[t or ""] == i else "revisit", None if last[t or ""] == i else last[t or ""]) for i, _, t in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_licenses_in_a_long_text_take_linear_time(spark):
    from rxlink.llm import license_scan

    words = " ".join(f"w{i % 997}" for i in range(50_000))
    rows = [(1, f"{words}\nReleased now under\nan MIT License, and all that follows"), (2, f"{words}\nthis project is licensed under\nthe MIT License. {words}")]
    found = {r.doc_id: r["__ls_best"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] is None and (found[2].license, found[2].unit) == ("MIT-licensed", 2)
