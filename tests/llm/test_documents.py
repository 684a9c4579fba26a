"""Mixing, licences, fingerprints, SimHash, toxicity and pieces on hostile rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import sentencepiece as library
import xxhash

from nudgeframe.llm import fingerprints, licenses, mixing, sentencepiece, simhash, toxicity


def size_of(text):
    return len((text or "").encode().split())


def test_mix_matches_the_definition(make_docs, hostile):
    out = mixing.mix(make_docs(hostile)).collect()
    sizes = {}
    for r in hostile:
        sizes[r[2]] = sizes.get(r[2], 0) + size_of(r[1])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    assert len(out) == len(hostile)
    for s in names:
        rows = [r for r in out if r["source"] == s]
        assert rows[0]["source_size"] == sizes[s] and math.isclose(rows[0]["target"], target[s], rel_tol=1e-9, abs_tol=1e-9)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
        assert abs(sum(r["taken"] for r in rows) - target[s]) <= max([2 * r["size"] for r in rows], default=0)
        epochs = {r["copies"] for r in rows if r["size"]}
        assert not epochs or max(epochs) - min(epochs) <= 1
    again = mixing.mix(make_docs(hostile)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_rows_without_ids_meet_their_target(make_docs):
    """Half of the rows have no id, some are equal in all: each is taken on its own."""
    rows = [(i, f"w{i} " * 10, "a") for i in range(600)]
    rows += [(None, f"v{i % 500} " * 10, "b") for i in range(600)] + [(7, "same words all over again", "c")] * 200
    out = mixing.mix(make_docs(rows)).collect()
    for source, size in (("a", 10), ("b", 10), ("c", 5)):
        mine = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= size
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(make_docs(rows).repartition(7)).collect()))
    whole = mixing.materialise(make_docs(rows)).groupBy("source").count().collect()
    taken = {s: sum(r["copies"] for r in out if r["source"] == s) for s in "abc"}
    assert {r["source"]: r["count"] for r in whole} == taken


def test_materialise_survives_columns_of_any_name(make_docs, spark):
    docs = make_docs([(i, f"w{i}", "a") for i in range(20)])
    for name in ("target", "epochs", "rest", "edge_bucket", "cut_key", "cut_source", "source_size", "n", "size", "w"):
        assert name in mixing.materialise(docs.drop(name).withColumn(name, docs["lang"])).columns
    with pytest.raises(ValueError):
        mixing.materialise(docs.withColumn("__mix_key", docs["lang"]))


def test_materialised_mix_repeats_rows(make_docs, hostile):
    docs = make_docs(hostile)
    out = mixing.materialise(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in mixing.mix(docs).collect())


def test_empty_tables(make_docs, spark):
    empty = make_docs([])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert mixing.mix(empty).count() == 0 and mixing.materialise(empty).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    assert fingerprints.fingerprint_neighbours(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    assert sentencepiece.digests(empty, sentencepiece.read_model()).count() == 0


def test_licences_match_brute_force(make_docs, hostile):
    mit = licenses.TEMPLATES["MIT"]
    rows = hostile + [
        (301, mit), (302, f"some\n{mit.replace('Software', 'Program', 2)}\nmore words"), (303, "Released under the  MIT license"),
        (304, "text\nLicensed under CC BY-NC 4.0.\nend"), (305, "license license license"), (306, mit[: len(mit) // 2]),
    ]
    grams = {n: licenses.bigrams(licenses.normalised_words(t)) for n, t in licenses.TEMPLATES.items()}

    def best(unit):
        own = licenses.bigrams(licenses.normalised_words(unit))
        found = [(-2 * len(own & g) / (len(own) + len(g)), n) for n, g in grams.items() if own]
        found = [f for f in found if -f[0] >= licenses.THRESHOLD]
        return min(found) if found else None

    out = licenses.scan_licenses(make_docs(rows)).collect()
    assert len(out) == len(rows)
    want = sorted(
        (r[0] if r[0] is not None else -1, sorted(filter(None, [best(u) for u in [r[1] or "", *((r[1] or "").split("\n") if "\n" in (r[1] or "") else [])]])))
        for r in rows
    )
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, sorted((-m["dice"], m["license"]) for m in r["matches"])) for r in out)
    assert got == want
    named = {r["doc_id"]: r["license"] for r in out}
    assert named[301] == named[302] == "MIT" and named[303] == "MIT-notice" and named[304] == "CC-BY-NC-4.0-notice" and named[306] is None


def all_windows(words, grams):
    """(-dice, template, first word, end) by the definition, over every window of words."""
    found = []
    for name, template in grams.items():
        for at in range(len(words) - 1):
            own, best = set(), (0.0, 0)
            for end in range(at + 2, len(words) + 1):
                own.add((words[end - 2], words[end - 1]))
                dice = 2 * len(own & template) / (len(own) + len(template))
                best = max(best, (dice, -end))
            if best[0] >= licenses.THRESHOLD:
                found.append((-best[0], name, at, -best[1]))
    kept = []
    for w in sorted(found):
        if all(w[3] <= k[2] or k[3] <= w[2] for k in kept):
            kept.append(w)
    return kept


def test_licence_windows_match_brute_force(make_docs):
    rng = random.Random(14)
    prose = lambda n: " ".join(rng.choice(["the", "of", "in", "work", "license", "under", "w1", "w2"]) for _ in range(n))
    wrapped = lambda text, mark: "\n".join(f"{mark} {' '.join(text.split()[i : i + 9])}" for i in range(0, len(text.split()), 9))
    texts = [f"{prose(200)}\n{wrapped(licenses.TEMPLATES[n], '#')}\n{prose(200)}" for n in ("MIT", "ISC", "Apache-2.0", "GPL-3.0")]
    texts += [f"{prose(9)}. Released under the MIT License, as {prose(9)} and licensed under CC BY-NC 4.0 {prose(5)}", prose(300)]
    texts += [f"{prose(20)} released under the MIT license {prose(20)} released under the  MIT license", " ".join(["the license under"] * 90)]
    scanner = licenses.Templates(licenses.TEMPLATES)
    grams = {n: licenses.bigrams(licenses.normalised_words(t)) for n, t in licenses.TEMPLATES.items()}
    for text in texts:
        words = licenses.normalised_words(text)
        assert scanner.windows(words) == all_windows(words, grams)
    out = {r["doc_id"]: r for r in licenses.scan_licenses(make_docs(list(enumerate(texts)))).collect()}
    assert [out[i]["license"] for i in range(4)] == ["MIT", "ISC", "Apache-2.0", "GPL-3.0"] and all(out[i]["dice"] > 0.9 for i in range(4))
    assert [m["license"] for m in out[4]["matches"]] == ["MIT-notice", "CC-BY-NC-4.0-notice"] and out[5]["n_matches"] == 0
    assert out[6]["n_matches"] == 2 and out[7]["license"] is None


def test_common_licences_are_told_apart(make_docs):
    names = ["BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "CC0-1.0-notice", "BSL-1.0-notice", "Zlib", "Unlicense"]
    wrap = lambda text: "\n".join(f" * {' '.join(text.split()[i : i + 11])}" for i in range(0, len(text.split()), 11))
    rows = [(i, f"def main():\n{wrap(licenses.TEMPLATES[n])}\nreturn the value of it") for i, n in enumerate(names)]
    out = {r["doc_id"]: (r["license"], r["dice"], r["n_matches"]) for r in licenses.scan_licenses(make_docs(rows)).collect()}
    assert [out[i][0] for i in range(len(names))] == names and all(d == 1.0 for _, d, _ in out.values())


def test_entropy_classes_and_likeness():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 105, 300_000).astype(np.uint8)
    data[1000:1300] = 65
    got = fingerprints.entropy_classes(data)
    for i in [*range(900, 1400, 13), *range(fingerprints.BLOCK - 90, fingerprints.BLOCK + 5), len(got) - 1]:
        counts = np.bincount(data[i : i + 64])
        p = counts[counts > 0] / 64
        assert abs(int(got[i]) - int(-(p * np.log2(p)).sum() / 6 * 1000 + 1e-9)) <= 0
    ranks = fingerprints.rarity(fingerprints.class_counts(data, np.array([0, len(data)])))
    text = data[:20_000].tobytes()
    one, same, part, other, none = fingerprints.digests([text, text, text[:14_000] + bytes(6000), data[50_000:70_000].tobytes(), b""], ranks)
    assert (one == same).all() and fingerprints.likeness(one, same) == 1.0
    assert fingerprints.likeness(one, part) > 0.4 > 0.1 > fingerprints.likeness(one, other)
    assert fingerprints.likeness(none, none) == 1.0 and fingerprints.likeness(one, none) == 0.0


def test_fingerprints_follow_the_next_document(make_docs, hostile):
    rows = [r for r in hostile if r[0] not in (205, 206)]
    got = fingerprints.fingerprint_neighbours(make_docs(rows)).collect()
    assert len(got) == len(rows)
    keyed = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for (a, text, *_), (_, following, *_) in zip(keyed, keyed[1:]):
        text, following = text or "", following or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        assert by_id[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and by_id[a]["n_chars"] == len(text)
        assert 0.0 <= by_id[a]["near_edited"] <= 1.0 and 0.0 <= by_id[a]["near_next"] <= 1.0
    single = fingerprints.fingerprint_neighbours(make_docs([(7, "abc" * 40)])).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1.0


def fingerprint_of(text):
    parts = (text or "").encode().translate(simhash.LOWER).split()
    grams = [b" ".join(parts[i : i + 4]) for i in range(max(1, len(parts) - 3))] if parts else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("block", [None, "4"])
def test_simhash_components_match_brute_force(spark, make_docs, hostile, block):
    rng = random.Random(9)
    base = [f"t{rng.randint(0, 9999)}" for _ in range(400)]
    rows = [r for r in hostile if r[0] != 205]
    for i in range(40):
        changed = list(base)
        for _ in range(rng.randint(0, 3)):
            changed[rng.randrange(400)] = f"u{rng.randint(0, 9999)}"
        rows.append((500 + i, " ".join(changed)))
    if block:
        spark.conf.set("spark.nudgeframe.bucketRows", block)
    try:
        got = simhash.near_duplicates(make_docs(rows)).collect()
    finally:
        spark.conf.unset("spark.nudgeframe.bucketRows")
    prints = [fingerprint_of(r[1]) for r in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        key = 2**63 - 1 if r[0] is None else r[0]
        least[find(i)] = min(least.get(find(i), 2**63), key)
    want = sorted((str(r[0]), prints[i], str(None if least[find(i)] == 2**63 - 1 else least[find(i)])) for i, r in enumerate(rows))
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, str(r["component_id"])) for r in got) == want
    kept = simhash.keep_one(make_docs(rows))
    assert kept.count() == len(set(least.values())) and kept.columns == make_docs(rows).columns


def test_keep_one_tells_components_with_one_id_apart(make_docs, hostile):
    rng = random.Random(10)
    rows = hostile + [(i, " ".join(f"n{rng.randint(0, 9999)}" for _ in range(50))) for i in [None] * 30 + [700] * 6]
    rows += [rows[-1], rows[-10]]
    prints = {fingerprint_of(r[1]) for r in rows}
    groups = []
    for p in prints:
        near = [g for g in groups if any((p ^ q).bit_count() <= 4 for q in g)]
        groups = [g for g in groups if g not in near] + [{p}.union(*near)]
    want = []
    for g in groups:
        own = [(2**63 - 1 if r[0] is None else r[0], r[1] or "") for r in rows if fingerprint_of(r[1]) in g]
        want.append((min(own)[0], frozenset(g)))
    kept = simhash.keep_one(make_docs(rows)).collect()
    got = []
    for r in kept:
        own = next(frozenset(g) for g in groups if fingerprint_of(r["text"]) in g)
        got.append((2**63 - 1 if r["doc_id"] is None else r["doc_id"], own))
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(r["doc_id"] is None for r in kept) >= 30


def test_pigeonring_filter_keeps_all_close_pairs():
    rng = np.random.default_rng(2)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(3000)], np.uint64)
    assert simhash.viable(flips).all()
    far = rng.integers(0, 2**63, 3000).astype(np.uint64)
    assert not simhash.viable(far[np.bitwise_count(far) > 12]).any()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_accepts_exactly_the_words_within_reach():
    rng = random.Random(4)
    terms = ["idiot", "scum", "worthless", "idle", "baabab"]
    matcher = toxicity.TermMatcher(terms, stems=["lostr"])
    words = terms + ["".join(rng.choice("abdilost") for _ in range(rng.randint(1, 9))) for _ in range(3000)] + ["lostrand", "ido", "worthles", "wrthles", "idiott"]
    for word in words:
        if word.startswith("lostr"):
            assert matcher.match(word) == (0, "lostr")
            continue
        near = [(d, t) for t in terms if (d := distance(word, t)) <= toxicity.edits_allowed(t)]
        assert matcher.match(word) == (min(near) if near else None), word


def test_toxicity_reads_context_and_survives_hostile_rows(spark, make_docs, hostile):
    rng = random.Random(6)
    bad = ["stupid", "worthless", "pathetic"]
    rows, labels = list(hostile), []
    for i in range(1000, 1400):
        text = [f"w{rng.randint(0, 300)}" for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (200, None), (201, 0), (1000, 1)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    scorer = toxicity.train(make_docs(rows, extra=False), table)
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.score(make_docs(rows, extra=False), scorer).collect()}
    held = [(out[i], y) for i, y in labels if i and i >= 1000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 50 and all((s >= toxicity.THRESHOLD) == bool(y) for s, y in held)
    said, abuse, typo = scorer.scores(['she said "worthless" again', "you worthless thing", "you worthles thing"])
    assert said < abuse and said < toxicity.THRESHOLD < typo
    assert toxicity.train(make_docs(rows, extra=False), table.filter("toxic = 0")).scores(["worthless"]).tolist() == [0.0]


def test_quotations_of_any_length_are_reported_speech():
    scorer = toxicity.Scorer(terms=("worthless",))
    for n in (2, 50, 300, 20_000):
        inside = "x " * n + "worthless " + "y " * n
        for text in (f'"{inside}"', f"“{inside}”", f"«{inside}»", f"„{inside}“"):
            assert scorer.features(text)[2] > 0, (n, text[:3])
        for text in (inside, f'"{inside}', f'"x" {inside} "y"', f'"{inside}\n"'):
            assert scorer.features(text)[2] == 0, (n, text[:3])
    assert toxicity.quoted_spans('5" «a» „b“ c "" d') == [(1, 14)]
    assert toxicity.quoted_spans("" ) == [] and toxicity.quoted_spans("“a «b» c” »") == [(0, 9)]


def test_toxicity_sample_stays_within_its_bound(spark, make_docs, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 50)
    free = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 4 != 2]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(free)] + [(free[0], 1)] * 500, "doc_id long, toxic int")
    # One id with many texts, one text many times, and every other id.
    rows = [(free[0], f"text {n}") for n in range(400)] + [(free[1], "same")] * 400 + [(i, f"word{i}") for i in range(1000)]
    docs = make_docs(rows, extra=False)
    taken = toxicity.labelled_sample(docs, labels).collect()
    assert len(taken) == 50
    toxic = {i: k % 2 for k, i in enumerate(free)} | {free[0]: 1}
    held = {f"word{i}" for i in range(1000)} - {f"word{i}" for i in free}
    assert not held & {r["text"] for r in taken} and sum(r["text"] == "same" for r in taken) <= 1
    assert all(r["toxic"] == toxic[int(r["text"][4:])] for r in taken if r["text"].startswith("word"))
    again = toxicity.labelled_sample(docs.repartition(5), labels.repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, taken))


def test_toxicity_keeps_columns_that_clash(spark, make_docs):
    docs = make_docs([(1, "a b"), (2, None), (None, "c")])
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    with pytest.raises(ValueError):
        toxicity.score(docs, toxicity.Scorer())


def test_toxicity_score_takes_the_place_of_a_column_without_rows(make_docs):
    empty = make_docs([])
    out = toxicity.score(empty, toxicity.Scorer())
    assert out.count() == 0 and out.columns == [*[c for c in empty.columns if c != "toxicity"], "toxicity"]
    assert dict(out.dtypes)["toxicity"] == "double"


def test_toxicity_of_held_out_documents(spark):
    """At least 0.9 of the toxic documents that no label was read for, few false alarms."""
    folder = "/root/testdata/sf0.1"
    out = toxicity.op8_toxicity(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in out.filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    found, missed = counts.get((1, 1), 0), counts.get((1, 0), 0)
    assert found >= 0.9 * (found + missed) > 50, counts
    assert counts.get((0, 1), 0) <= 0.01 * counts[(0, 0)], counts
    ids = [r["doc_id"] for r in out.filter("held_out").select("doc_id").collect()]
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in ids)


TEXTS = [None, "", " ", "a", "  two  spaces ", "\n\n\tx", "漢字 ☃ 𝄞 é́", "x" * 3000, "ab" * 400, "<0x41></s><s>", " " * 300 + "q", "foo\x00bar, baz.", "l'été… «oui», d'accord"]


def test_pieces_equal_the_library(make_docs, hostile):
    model = sentencepiece.read_model()
    own, other = sentencepiece.Model(model), library.SentencePieceProcessor(model_proto=model)
    rng = random.Random(8)
    texts = TEXTS + [r[1] for r in hostile] + ["".join(rng.choice("theandosing ,.▁éß漢\n") for _ in range(300)) for _ in range(30)]
    for text in texts:
        ids = own.encode(text or "")
        assert ids == other.encode(text or "")
        assert own.decode(ids) == (text or "").replace("▁", " ")


def test_pieces_round_trip_in_frames(make_docs):
    docs = make_docs(list(enumerate(TEXTS)))
    model = sentencepiece.read_model()
    out = sentencepiece.decode(sentencepiece.encode(docs, model), model)
    assert out.columns == [*docs.columns, "piece_ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in out.collect())
    assert all(r["exact"] for r in sentencepiece.digests(docs, model).collect())
