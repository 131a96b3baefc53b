"""Operators on documents against brute force, with every awkward case."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from histolode.llm import common, components, lines, mixing, near_dup, packing, repeats, suffix_tree, surrogates, toxicity
from histolode.llm.common import id_text_crc
from tests.compare import SF
from tests.llm import data

DATA = data.rows()
EMPTY: list[tuple] = []


def held(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


# -- 1 ---------------------------------------------------------------------------------


def brute_tree(rows, max_depth, min_count, min_gain):
    texts = [(r[0], not held(r[0]), ["<", *data.words(r[1]), "<"]) for r in rows]  # "<" at both ends: the end symbol
    count = Counter(t for _, train, ts in texts if train for t in ts[1:])
    n, v = sum(count.values()), len(count)
    root = lambda x: (count[x] + 0.1) / (n + 0.1 * (v + 1))
    docs = sum(train for _, train, _ in texts)
    seen = {0: Counter({(k,): c for k, c in count.items() if k != "<"}) + Counter({("<",): docs})}
    kept: dict[tuple, float] = {}

    def p(context, x):
        value = root(x)
        for d in range(1, len(context) + 1):
            s = context[-d:]
            if s not in kept:
                break
            value = (seen[d][(*s, x)] + kept[s] * value) / (seen[d - 1][s] + kept[s])
        return value

    for d in range(1, max_depth + 1):
        grams = Counter()
        for _, train, ts in texts:
            for i in range(d, len(ts)):
                s = tuple(ts[i - d : i])
                if train and seen[d - 1][s] >= min_count and (d == 1 or s[1:] in kept):
                    grams[(*s, ts[i])] += 1
        seen[d] = grams
        by = defaultdict(list)
        for g, c in grams.items():
            by[g[:-1]].append((c, p(g[1:-1], g[-1])))
        for s, found in by.items():
            total = seen[d - 1][s]
            gains = [sum(c * math.log((c - 1 + k * q) / (total - 1 + k) / q) for c, q in found) for k in suffix_tree.STRENGTHS]
            if max(gains) >= min_gain * total:
                kept[s] = float(suffix_tree.STRENGTHS[int(np.argmax(gains))])
    out = {}
    for doc, _, ts in texts:
        base = sum(math.log10(root(t)) for t in ts[1:])
        score = sum(math.log10(p(tuple(ts[max(0, i - max_depth) : i]), ts[i])) for i in range(1, len(ts)))
        out[doc] = (held(doc), len(ts) - 1, sum(count[t] > 0 for t in ts[1:]), n, base, score)
    return out


@pytest.mark.parametrize("depth, part_bytes", [(None, 32 << 20), (2, 1000)])
def test_suffix_tree_equals_brute_force(spark, monkeypatch, depth, part_bytes):
    monkeypatch.setattr(common, "PART_BYTES", part_bytes)
    rows = [r for r in DATA if r[0] != 9] + [(200 + i, f"a b c a b d {i % 3} a b c", "en", "z", 1) for i in range(20)]
    expected = brute_tree(rows, depth or 15, 2, 0.02)
    docs = data.documents(spark, rows).withColumn("train", id_text_crc() % 10 != 0)
    found = suffix_tree.score_texts(docs, depth, last_level_gain=0.0).collect()
    assert len(found) == len(rows)
    for r in found:
        e = expected[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == e[:4]
        assert r["base_score"] == pytest.approx(e[4], abs=1e-9) and r["score"] == pytest.approx(e[5], rel=1e-4)


def test_suffix_tree_grows_until_no_context_passes(spark):
    docs = data.documents(spark, DATA).withColumn("train", F.lit(True))
    scores = lambda **more: sorted((r["doc_id"], round(r["score"], 9)) for r in suffix_tree.score_texts(docs, **more).where("doc_id is not null").collect())
    whole = scores()
    assert whole == scores(last_level_gain=0.0) != scores(last_level_gain=0.5)


@pytest.mark.parametrize("depth, kept", [(0, ["level0", "texts"]), (3, ["level3", "walk3"]), (4, ["level4", "walk4"])])
def test_suffix_tree_resumes_the_walks_of_deep_levels(spark, depth, kept):
    # with the replies of all levels, each level was walked again for all deeper ones
    docs = data.documents(spark, DATA).withColumn("train", F.lit(True))
    with common.Scratch.collected() as made:
        scores = suffix_tree.score_texts(docs, depth)
    assert [sorted(tables.paths) for tables in made] == [kept]
    assert scores.count() == len(DATA)


@pytest.mark.parametrize("n, high", [(0, 5), (1, 5), (2000, 20), (2000, 1 << 30)])
def test_distinct_pairs_and_places(n, high):
    state, symbol = (np.random.default_rng(i).integers(0, high, n).astype(np.int32) for i in (1, 2))
    a, b, place = suffix_tree._distinct(state, symbol)
    pairs = list(zip(a.tolist(), b.tolist(), strict=True))
    assert pairs == sorted(set(zip(state.tolist(), symbol.tolist(), strict=True)))
    assert [pairs[i] for i in place] == list(zip(state.tolist(), symbol.tolist(), strict=True))


@pytest.mark.parametrize("keys", [[5], [7, 7, 7], [(9 << 40) + i % 3 for i in range(50)], [(i * 2654435761) % 97 << 50 for i in range(500)]])
def test_runs_of_equal_keys(keys):
    keys = np.array(keys, np.uint64)
    order, starts, run = suffix_tree._runs(keys)
    assert sorted(order.tolist()) == list(range(len(keys)))
    assert len(starts) == len(set(keys.tolist())) and (keys[order[starts]][run] == keys).all()


def test_gains_of_grams_seen_once_need_no_logarithm_each(monkeypatch):
    # each gram had a logarithm for each strength
    log, taken = np.log, []
    monkeypatch.setattr(np, "log", lambda x: taken.append(np.size(x)) or log(x))
    made = suffix_tree.Model(10**6, 1000, 10, 1, 2, 0.02)
    states = np.arange(1, 11, dtype=np.uint64) << np.uint64(50)
    n = np.ones(1010, np.uint32)
    n[::101], n[1::101] = 5, 0
    grams = suffix_tree._together([states, np.full(10, 104, np.uint32), np.full(10, 101, np.uint32), np.tile(np.arange(101, dtype=np.uint32), 10), n, np.full(1010, 0.0001, np.float32)])
    reply = suffix_tree._merge(made, 1)(pa.table({"chunk": [1], "part": [0], "grams": [grams], "n": [1010]})).to_pylist()
    assert sum(taken) <= 2 * 10 * len(suffix_tree.STRENGTHS)
    q = float(np.float32(0.0001))
    gains = [sum(c * math.log((c - 1 + k * q) / (104 - 1 + k) / q) for c in [5, *[1] * 99]) for k in suffix_tree.STRENGTHS]
    code = int(np.argmax(gains)) + 1 if max(gains) >= 0.02 * 104 else 0
    assert common.unpack(reply[0]["counts"]).tolist() == (n.astype(int) * 16 + code).tolist()
    assert reply[1]["gains"] == [pytest.approx(10 * max(gains) if code else 0.0)]


def test_suffix_tree_on_odd_tables(spark):
    docs = data.documents(spark, data.with_odd_rows(DATA)).withColumn("train", id_text_crc() % 10 != 0)
    assert suffix_tree.score_texts(docs).count() == len(DATA) + 4
    assert suffix_tree.score_texts(data.documents(spark, EMPTY).withColumn("train", F.lit(True))).count() == 0
    untrained = suffix_tree.score_texts(data.documents(spark, DATA[:3]).withColumn("train", F.lit(False))).collect()
    assert all(r["score"] == r["base_score"] == 0 and r["train_tokens"] == 0 for r in untrained)


# -- 3 ---------------------------------------------------------------------------------


def toxic_rows():
    rng = random.Random(5)
    bad = ["vileone", "vileduo", "viletrio"]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 8 == 0
        text = [f"word{rng.randrange(300)}" for _ in range(40)] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(text)
        docs.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_is_learnt_and_generalises(spark):
    docs, labels = toxic_rows()
    truth = dict(labels)
    table = data.documents(spark, docs)
    model = toxicity.fit(table, spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int"))
    found = toxicity.score(table.select("doc_id", "text"), model).collect()
    assert sum((r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in found if r["doc_id"] % 5 == 0) >= 118
    assert all(0 <= r["score"] <= 1 for r in found)


def test_toxicity_on_odd_tables(spark):
    docs, labels = toxic_rows()
    odd = data.documents(spark, data.with_odd_rows(docs[:200] + [(900, "", "en", "s", 0), (901, "z " * 50_000, "en", "s", 0)]))
    marks = spark.createDataFrame([*labels[:200], (None, 1), (3, None), (8, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd, marks)
    scored = toxicity.score(odd, model)
    assert scored.count() == 206 and scored.columns == [*[c for c in odd.columns if c != "score"], "score"]
    assert toxicity.fit(data.documents(spark, EMPTY), marks) is None
    assert toxicity.score(odd.select("doc_id", "text"), None).agg(F.max("score")).first()[0] == 0


def test_label_model_finds_accurate_and_dependent_voters():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.15
    good = lambda: np.where(y & (rng.random(3000) < 0.7), 1, 0) | (rng.random(3000) < 0.01)
    noise = (rng.random(3000) < 0.1).astype(int)
    votes = np.stack([*(good() for _ in range(5)), noise, noise, noise], axis=1).astype(np.int8)
    posterior = toxicity.label_model(votes, 0.15)
    assert ((posterior > 0.5) == y).mean() > 0.97


# -- 4 ---------------------------------------------------------------------------------


def brute_removal(rows, n=100):
    seen, out = set(), {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - n + 1):
            if raw[i : i + n] in seen:
                gone[i : i + n] = True
            seen.add(raw[i : i + n])
        out[doc] = repeats.removal_digest(doc, raw, gone)[1:]
    return out


REPEAT_ROWS = [*DATA, (300, "abc" * 200, "en", "s", 1), (301, "zz" + "abc" * 120 + "q", "en", "s", 1), (302, "é" * 90 + "k" * 99, "en", "s", 1), (303, "é" * 90 + "k" * 98, "en", "s", 1)]


def test_repeats_equal_brute_force(spark):
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    found = repeats.without_repeats(data.documents(spark, REPEAT_ROWS).repartition(5), repeats.removal_digest, schema).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == brute_removal(REPEAT_ROWS)
    assert repeats.without_repeats(data.documents(spark, EMPTY), repeats.removal_digest, schema).count() == 0
    assert repeats.without_repeats(data.documents(spark, data.with_odd_rows(DATA)), repeats.removal_digest, schema).count() == len(DATA) + 4


def test_groups_hold_all_occurrences(spark):
    passage = "".join(random.Random(1).choices("abcdefghij", k=160))
    rows = [(i, f"{i}" * 5 + passage + "!" * (i + 1), "en", "s", 1) for i in range(6)]
    groups = repeats.repeat_groups(data.documents(spark, rows)).collect()
    assert groups and max(len(g["occurrences"]) for g in groups) == 6
    for g in groups:
        assert len(g["text"]) >= 100
        for o in g["occurrences"]:
            raw = rows[o["doc_id"]][1].encode()
            assert raw[o["start"] : o["start"] + len(g["text"])] == bytes(g["text"])


def test_intervals_of_a_stack_scan():
    assert sorted(repeats.lcp_intervals([3, 1, 3, 3], 1)) == [(1, 0, 4), (3, 0, 1), (3, 2, 4)]


# -- 5 ---------------------------------------------------------------------------------


def brute_lines(rows, min_docs, keep_first=False):
    key = lambda line: data.lower(line.strip(" \t\n\x0b\x0c\r"))
    split = {r[0]: (r[1] or "").split("\n") for r in rows}
    docs = defaultdict(set)
    for d, ls in split.items():
        for line in ls:
            docs[key(line)].add(d)
    out, seen = {}, set()
    for d in sorted(split):
        keep = []
        for line in split[d]:
            k = key(line)
            often = k and len(docs[k]) >= min_docs
            if not often or (keep_first and k not in seen):
                keep.append(line)
            seen.add(k)
        out[d] = "\n".join(keep)
    return out


@pytest.mark.parametrize("min_docs, keep_first", [(10, False), (2, False), (2, True), (1, True)])
def test_lines_equal_brute_force(spark, min_docs, keep_first):
    docs = data.documents(spark, DATA).repartition(4)
    kept = lines.drop_lines(docs, lines.line_bitmaps(docs, min_docs, 1, keep_first))
    assert kept.columns == docs.columns
    expected = brute_lines(DATA, min_docs, keep_first)
    found = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert {d: t or "" for d, t in found.items()} == expected and found[4] is None


def test_lines_on_odd_tables(spark):
    docs = data.documents(spark, data.with_odd_rows(DATA))
    kept = lines.drop_lines(docs, lines.line_bitmaps(docs, 10)).collect()
    assert len(kept) == len(DATA) + 4 and any(r["doc_id"] is None and r["text"] == DATA[0][1] for r in kept)
    assert lines.line_bitmaps(data.documents(spark, EMPTY), 10).count() == 0


# -- 6 ---------------------------------------------------------------------------------


def brute_near(rows):
    sets = {}
    for doc, text, *_ in rows:
        w = data.words(text)
        sets[doc] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {d: (len(sets[d]), label[d], label[d] == d) for d in sets}


def near_rows():
    rng = random.Random(3)
    rows, base = list(DATA), [f"t{i}" for i in range(90)]
    for i in range(60):  # a chain of copies, each edited a little more
        base[rng.randrange(90)] = f"e{i}"
        rows.append((1000 + i, " ".join(base), "en", "n", 1))
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    found = near_dup.near_duplicates(data.documents(spark, rows)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == brute_near(rows)


def lengthened(rows):
    """Besides, copies that grow by a few words each, so that many sizes meet in the same buckets."""
    rng, words = random.Random(4), [f"g{i}" for i in range(40)]
    for i in range(50):
        words += [f"g{i}x{k}" for k in range(rng.randrange(1, 9))]
        rows.append((2000 + i, " ".join(words), "en", "n", 1))
    return rows


@pytest.mark.parametrize("block, size, edges", [(4, 1 << 24, 8), (1024, 400, 1 << 18)])
def test_near_duplicates_in_small_blocks(spark, monkeypatch, block, size, edges):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", size)
    monkeypatch.setattr(components, "TASK_EDGES", edges)
    rows = lengthened(near_rows())
    found = near_dup.near_duplicates(data.documents(spark, rows).repartition(5)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == brute_near(rows)


def test_near_duplicates_on_odd_tables(spark):
    found = near_dup.near_duplicates(data.documents(spark, data.with_odd_rows(DATA))).collect()
    assert len(found) == len(DATA) + 4 and all(r["component_id"] is None for r in found if r["doc_id"] is None)
    assert near_dup.near_duplicates(data.documents(spark, EMPTY)).count() == 0


def test_odd_sketches_estimate_high_similarity():
    a, b = near_dup._permutations()
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    for share in (0.75, 0.9, 1.0):
        n = int(len(x) * 2 * share / (1 + share))
        y = np.unique(np.r_[x[:n], rng.integers(0, 2**63, len(x) - n).astype(np.uint64)])
        one, two = (near_dup.odd_sketch(near_dup.samples(s, a, b)) for s in (x, y))
        assert abs(float(near_dup.estimates(one, two)) - share) < 0.15


# -- 8 ---------------------------------------------------------------------------------

ENTITIES = [
    (1, "Mail JO.Doe@Example.com, jo.doe@example.com; call +1 (212) 555-0199 or 1 (212) 555-0199.", "en", "s", 1),
    (2, "card 4111111111111111 and 4111 1111 1111 1111, host 10.20.30.40!", "en", "s", 1),
    (3, 'token = "7f5790b897549d620aedfc0705a565f96e3741e8" ssn 123-45-6789', "en", "s", 1),
    (4, "Frau Anna Schmidt und Herr Schmidt; Mr. JOHN SMITH; г-жа Анна Иванова", "de", "s", 1),
    (5, "nothing here 12 3.14 v1.2.3", "en", "s", 1),
    (6, None, None, None, None),
    (7, "", "en", "s", 0),
]


def test_surrogates_keep_kind_format_and_coreference(spark):
    docs = data.documents(spark, ENTITIES)
    found = {r["doc_id"]: r for r in surrogates.replace_entities(docs, "k").collect()}
    assert [found[i]["n_entities"] for i in range(1, 8)] == [4, 3, 2, 4, 0, 0, 0]
    for i, text, *_ in ENTITIES[:4]:
        assert found[i]["text"] != text
    mails = re.findall(r"[\w.]+@[\w.]+\.com", found[1]["text"])
    assert mails[0].lower() == mails[1].lower()
    a, b = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", found[2]["text"])
    assert a == b.replace(" ", "") and a[0] == "4" and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(a))) % 10 == 0
    assert re.search(r'"[0-9a-f]{40}" ssn \d{3}-\d{2}-\d{4}', found[3]["text"])
    german, herr, mister, russian = re.findall(r"(?:Frau|Herr|Mr\.|г-жа) [^;]+?(?= und|;|$)", found[4]["text"])
    assert german.split()[2] == herr.split()[1] and german.split()[1].endswith("a") and mister.split()[1].isupper() and "а" <= russian.split()[1][-1] <= "я"
    assert found[5]["text"] == ENTITIES[4][1] and found[6]["text"] is None and found[7]["text"] == ""
    again = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(docs.repartition(3), "k").collect()}
    assert again == {d: r["text"] for d, r in found.items()}
    assert {r["text"] for r in surrogates.replace_entities(docs, "other").collect()} != set(again.values())


NAMES = [
    (20, "Mr. John Smith met Ana. Later Smith left and John Smith wrote to SMITH; smith is a trade, Smithson a name, Smith's hat his.", "en", "s", 1),
    (21, "Smith never had a title here.", "en", "s", 1),
    (22, "Herr Jean-Luc O’Brien und Frau O’Brien. O’Brien kam, Jean-Luc ging.", "de", "s", 1),
    (23, "sha 7f5790b897549d620aedfc0705a565f96e3741e8 stays, api_key: 7F5790B897549D620AEDFC0705A565F9 goes", "en", "s", 1),
    (24, "to " + "Q" * 30 + "x" * 30 + "@" + "a" * 60 + "." + "b" * 60 + "." + "c" * 60 + ".example.org now", "en", "s", 1),
]


def test_later_mentions_of_a_name_are_replaced(spark):
    found = {r["doc_id"]: r for r in surrogates.replace_entities(data.documents(spark, NAMES), "k").collect()}
    mister, given, family = found[20]["text"].split()[:3]
    assert found[20]["text"] == f"{mister} {given} {family} met Ana. Later {family} left and {given} {family} wrote to {family.upper()}; smith is a trade, Smithson a name, {family}'s hat his."
    assert family not in ("Smith", "John") and found[20]["n_entities"] == 6
    assert found[21]["text"] == NAMES[1][1] and found[21]["n_entities"] == 0
    _, luc, brien, _, _, again, *_ = re.split(r"[ .]+", found[22]["text"])
    assert brien == again and found[22]["text"].endswith(f"{brien} kam, {luc} ging.") and "Brien" not in found[22]["text"]
    assert "sha 7f5790b897549d620aedfc0705a565f96e3741e8 stays" in found[23]["text"] and re.search("api_key: [0-9A-F]{32} goes", found[23]["text"]) and found[23]["n_entities"] == 1
    assert len(found[24]["text"]) == len(NAMES[4][1]) and found[24]["text"].endswith(".org now")


def brute_mentions(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, canonical text) of all mentions: entities by one search, then parts of names by another."""
    found = []
    for m in regex.finditer(surrogates.PATTERN, text or ""):
        kind = next(k for k, p in surrogates._ALONE.items() if regex.fullmatch(p, m.group()))
        shape = {"phone": r"\D", "card": r"\D", "ssn": r"\D", "iban": " "}.get(kind)
        if kind != "name":
            found.append((m.start(), m.end(), f"{kind}:{regex.sub(shape, '', m.group()) if shape else m.group().lower() if kind == 'email' else m.group()}"))
        else:
            at = m.start() + len(m.group().split(" ")[0]) + 1
            for word in m.group().split(" ")[1:]:
                found.append((at, at + len(word), f"name:{word.lower()}"))
                at += len(word) + 1
    names = {c for *_, c in found if c.startswith("name:")}
    taken = [(a, b) for a, b, _ in found]
    for m in regex.finditer(r"\p{L}+(?:['’-]\p{L}{2,})*", text or ""):
        if names and f"name:{m.group().lower()}" in names and m.group()[0] != m.group()[0].lower() and not any(a < m.end() and m.start() < b for a, b in taken):
            found.append((m.start(), m.end(), f"name:{m.group().lower()}"))
    return sorted(found)


def test_surrogates_against_a_brute_search(spark):
    files = [(r["doc_id"], r["text"], "en", "s", 1) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = files + [(10_000 + r[0], *r[1:]) for r in ENTITIES + NAMES]
    found = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(data.documents(spark, rows), "k").collect()}
    drawn = defaultdict(set)
    for doc, text, *_ in rows:
        mentions = brute_mentions(text)
        if not mentions:
            assert found[doc] == text
            continue
        between = [text[a:b] for a, b in zip([0, *(m[1] for m in mentions)], [*(m[0] for m in mentions), len(text)], strict=True)]
        hit = regex.fullmatch("(.*?)".join(map(regex.escape, between)), found[doc], regex.DOTALL)
        assert hit, doc
        for (_, _, canonical), new in zip(mentions, hit.groups(), strict=True):
            kind = canonical.split(":")[0]
            drawn[canonical].add(regex.sub(r"[^0-9]", "", new) if kind in ("phone", "card", "ssn") else new.replace(" ", "") if kind == "iban" else new if kind == "secret" else new.lower())
    assert len(drawn) > 20 and all(len(v) == 1 for k, v in drawn.items() if k != "name:schmidt")
    pairs = [(k.split(":")[0], *v) for k, v in drawn.items() if len(v) == 1]
    assert len(set(pairs)) == len(pairs) and not {f"{k}:{v}" for k, v in pairs} & set(drawn)


def test_surrogates_stay_distinct_under_collisions(spark):
    rows = [(i, f"ssn {i % 1000:03d}-{i // 1000:02d}-0000", "en", "s", 1) for i in range(1500)]
    import histolode.llm.surrogates as s

    class Scratch(s.Scratch):
        pass

    parts = spark.createDataFrame([("tiny", str(i)) for i in range(60)], "kind string, text string")
    original, s.draw = s.draw, lambda kind, text, key, attempt: F.concat(F.lit("s"), F.pmod(F.xxhash64(text, attempt), F.lit(200)).cast("string"))
    try:
        table = s.surrogate_table(parts, Scratch(spark, "test"), "k").collect()
    finally:
        s.draw = original
    assert len({r["surrogate"] for r in table}) == 60
    found = surrogates.replace_entities(data.documents(spark, rows), "k").collect()
    assert len({r["text"] for r in found}) == 1500 and not {r["text"] for r in found} & {r[1] for r in rows}


def test_surrogates_on_odd_tables(spark):
    assert surrogates.replace_entities(data.documents(spark, data.with_odd_rows(ENTITIES)), "k").count() == len(ENTITIES) + 4
    assert surrogates.replace_entities(data.documents(spark, EMPTY), "k").count() == 0


# -- 9 ---------------------------------------------------------------------------------


def test_mix_meets_targets_and_repeats_agree(spark):
    docs = data.documents(spark, [(i, "w " * (1 + i % 5), "en", f"s{i % 7}" if i % 11 else None, 1) for i in range(3000)])
    found = mixing.mix_schedule(docs).collect()
    sums = defaultdict(int)
    for r in found:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        sums[(r["source_size"], r["target"])] += r["taken"]
    assert all(abs(taken - target) <= 12 for (_, target), taken in sums.items())
    assert sum(t for _, t in sums) == pytest.approx(1.5 * sum(s for s, _ in sums))
    again = mixing.mix_schedule(docs.repartition(7)).collect()
    assert sorted(tuple(r) for r in again) == sorted(tuple(r) for r in found)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in found)


def test_repeated_rows_are_mixed_one_by_one(spark):
    rows = [(1, "one two three", "en", "a", 1)] * 7 + [(2, "four five", "en", "b", 1), (3, "six", "en", "c", 1), (1, "one two three", "en", "b", 1)]
    docs = data.documents(spark, rows)
    found = mixing.mix_schedule(docs).collect()
    mixed = Counter((r["doc_id"], r["source"]) for r in mixing.mix(docs).collect())
    assert sum(mixed.values()) == sum(r["copies"] for r in found) and mixed[1, "a"] == sum(r["copies"] for r in found if r["doc_id"] == 1 and r["source_size"] == 21)


def test_mix_on_odd_tables(spark):
    odd = data.documents(spark, data.with_odd_rows(DATA))
    assert mixing.mix_schedule(odd).count() == len(DATA) + 4 and mixing.mix(odd).columns == odd.columns
    assert mixing.mix_schedule(data.documents(spark, EMPTY)).count() == 0 and mixing.mix(data.documents(spark, EMPTY)).count() == 0
    blank = mixing.mix_schedule(data.documents(spark, [(1, None, None, None, None), (2, " ", "en", "a", 1)])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in blank] == [(0, 0, 0.0), (0, 0, 0.0)]


# -- 10 --------------------------------------------------------------------------------


def test_packing_is_a_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    docs = data.documents(spark, data.with_odd_rows(DATA)).repartition(3)
    pieces = packing.pack_pieces(docs, path, with_ids=True).collect()
    expected = Counter(tuple([*own.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in data.with_odd_rows(DATA))
    stream, by_doc = {}, defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"] and p["offset"] + p["length"] <= 2048
        stream[p["sequence_id"] * 2048 + p["offset"]] = p["length"]
        by_doc[p["sequence_id"] * 2048 + p["offset"] - p["start"]].append((p["start"], ids))
    at = 0
    for start in sorted(stream):
        assert start == at  # no gap, nothing twice
        at += stream[start]
    assert Counter(tuple(np.concatenate([i for _, i in sorted(parts, key=lambda x: x[0])]).tolist()) for parts in by_doc.values()) == expected
    whole = packing.pack_sequences(docs, path).collect()
    assert all(len(r["ids"]) == 2048 for r in whole) and sum(r["n_tokens"] for r in whole) == at
    assert packing.pack_pieces(data.documents(spark, EMPTY), path).count() == 0


def test_fast_encoder_equals_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as file:
        encode, _ = packing.encoder(file.read())
    own = Tokenizer.from_file(path)
    for text in [*(r[1] or "" for r in DATA), "a  b   c\n\n\t d", "naïve — “q” 東京 ١٢٣ ½ x²", "<|endoftext|><|endoftext|>x", "   sp", "👩‍👩‍👧"]:
        assert encode(text) == own.encode(text, add_special_tokens=False).ids
