import random
import re

from gridwright.llm import licenses

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    found, labels = [], set()
    for phrase, label in PHRASES.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                found.append(i)
                labels.add(label)
    return len(words), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["cc", "by", "CC-BY", "general", "public", "license", "General Public License", "all", "rights", "reserved", "All rights\nreserved.", "x", "Ünï", "the"]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(300, None), (300, ""), (301, "cc by " * 5000), (301, "cc by " * 5000), (None, "cc by")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.license_report(df).where("doc_id is not null").collect())
    want = sorted((False, i, *plain(t)) for i, t in rows if i is not None)
    assert str(got) == str(want)
    assert licenses.license_report(df.where("doc_id is null")).first()["n_base"] == 1
    assert licenses.license_report(df.limit(0)).count() == 0


def test_wordings_with_a_word_more_or_less(spark):
    rows = [
        (0, "It is licensed under the Apache License, Version 2.0 (the)."),
        (1, "Permission is hereby granted, free of any charge, to any person obtaining a copy of this great software"),
        (2, "licensed under terms of the version"),
        (3, "Permission is hereby granted. " + "x " * 50 + "free of charge to any person. " + "y " * 50 + "obtaining a copy of this software"),
    ]
    got = {r["doc_id"]: r for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["labels"] == "apache-2.0" and got[0]["score"] == 1.0
    assert got[1]["labels"] == "mit" and 0.7 <= got[1]["score"] < 1
    assert got[2]["labels"] == "" and got[3]["labels"] == ""
    hit = licenses.license_hits(spark.createDataFrame(rows[:1], "doc_id long, text string")).first()["hits"][0]
    assert (hit["first_word"], hit["end_word"]) == (2, 10)


def test_spans_are_verified_word_by_word(spark):
    rows = [
        (0, "General Public License, General Public License"),
        (1, "of this of this any person any person a copy a copy to any to any is hereby is hereby of charge of charge free of free of granted free granted free"),
        (2, "GNU Lesser General Public License, version 3"),
    ]
    got = {r["doc_id"]: r for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["labels"] == "gpl" and got[1]["labels"] == "" and got[1]["score"] == 0.0
    assert got[2]["labels"] == "gpl,lgpl" and got[2]["score"] == 1.0


def best_alignment(wording, own):
    """Smith-Waterman in plain loops: points, first word and end of the best, the one that ends first, then the latest start."""
    rows = [[(0, j) for j in range(len(own) + 1)]]
    best = (0, 0, 0)
    for w in wording:
        last, row = rows[-1], [(0, 0)]
        for j, x in enumerate(own, 1):
            step = 2 if x == w else -1
            row.append(max((0, j), (last[j - 1][0] + step, last[j - 1][1]), (last[j][0] - 1, last[j][1]), (row[j - 1][0] - 1, row[j - 1][1])))
        rows.append(row)
        for j, (points, start) in enumerate(row):
            if points > best[0]:
                best = (points, start, j)
    return best


def method_labels(text, templates):
    """Label -> best score, by votes counted in dictionaries and alignments in loops."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    known = set()
    for t in [*PHRASES, *templates.values()]:
        own = t.split()
        k = 3 if len(own) >= 20 else 2
        known |= {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}
    found = {}
    for label, t in templates.items():
        own = t.split()
        k = 3 if len(own) >= 20 else 2
        grams = [tuple(own[i : i + k]) for i in range(len(own) - k + 1)]
        votes = {}
        for at in range(len(words) - k + 1):
            for place, g in enumerate(grams):
                if tuple(words[at : at + k]) == g:
                    votes.setdefault(at - place, set()).add(place)
        groups = []
        for d in sorted(votes):
            if groups and d - groups[-1][-1] <= licenses.SHIFT:
                groups[-1].append(d)
            else:
                groups.append([d])
        for group in groups:
            if len(set().union(*(votes[d] for d in group))) < licenses.COVER * len(grams):
                continue
            lo, hi = min(d + min(votes[d]) for d in group), max(d + max(votes[d]) + k for d in group)
            seen = [None] * (hi - lo)
            for at in range(lo, hi):
                for n in (2, 3):
                    if at + 2 <= hi and tuple(words[at : at + n]) in known:
                        for j in range(at, min(at + n, hi)):
                            seen[j - lo] = words[j]
            points, _, _ = best_alignment(own, seen)
            if points >= licenses.COVER * 2 * len(own):
                found[label] = max(found.get(label, 0), points / (2 * len(own)))
    return found


def test_query_against_brute_force(spark, tmp_path):
    """Labels and scores of every document, the method's too, over edited copies of all wordings."""
    from gridwright.llm import queries

    rng = random.Random(5)
    filler = "the of and to any license software version river stone copy this free in".split()
    rows = []
    for i, t in enumerate([*licenses.TEMPLATES.values()] * 4):
        words = [w for w in t.split() if rng.random() > 0.03 * (i % 4)]
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(filler))
        around = lambda: [rng.choice(filler) for _ in range(rng.randint(0, 30))]
        rows.append((i, " ".join(around() + words + around() + (words[: len(words) // 2] if i % 3 else words))))
    rows += [(1000 + i, " ".join(rng.choice(filler) for _ in range(200))) for i in range(10)] + [(2000, "All rights reserved. cc by"), (2001, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op6_licenses(spark, str(tmp_path)).collect()}
    labelled = 0
    for i, text in rows:
        base, own = plain(text)[4], method_labels(text or "", licenses.TEMPLATES)
        assert got[i]["labels"] == ",".join(sorted({*own, *(x for x in base.split(",") if x)})), text
        assert abs(got[i]["score"] - max([*own.values(), *([1.0] if base else [])], default=0.0)) < 1e-9
        labelled += bool(own)
    assert labelled > 50
