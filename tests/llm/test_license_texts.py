"""Whole license texts, wrapped as published, are found."""

from stridelake.llm import license_scan

WHOLE = {name: text for name, text in license_scan.TEMPLATES if text.count("\n") > 5}


def test_whole_texts_are_templates():
    assert {"BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "Apache-2.0"} <= set(WHOLE)
    assert all("IN NO EVENT SHALL" in WHOLE[n] for n in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense"))


def test_whole_texts_are_found(spark):
    names = sorted(WHOLE)
    rows = [(i, f"{n} License\n\nCopyright (c) 2019, The Example Authors\n\n{WHOLE[n]}") for i, n in enumerate(names)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).filter("unit = 'text'").collect()
    found = {(r["doc_id"], r["license"]) for r in got}
    assert found >= {(i, n) for i, n in enumerate(names)}
    assert not {x for x in found if x[1] in ("ISC", "Unlicense", "CC0-1.0", "Apache-2.0")} - set(enumerate(names))


def dice(a, b):
    from collections import Counter

    x, y = (Counter(zip(w, w[1:])) for w in (a, b))
    n = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / n if n else 0


def brute_force(rows):
    """(doc_id, license, template, start_word, dice) of the best span of each run of overlapping spans, by plain search over all spans."""
    from collections import Counter

    out = []
    for doc, text in rows:
        words = license_scan.words_of(text or "")
        grams, hits = list(zip(words, words[1:])), {}
        for k, (name, template) in enumerate(license_scan.TEMPLATES):
            t = license_scan.words_of(template)
            want, size = Counter(zip(t, t[1:])), len(t) - 1
            least, most = license_scan.size_bounds(size, license_scan.THRESHOLD)
            at = [i for i, g in enumerate(grams) if g in want]
            if len(at) < least:
                continue
            by_start, by_end = {}, {}
            for x, s in enumerate(at):
                seen, common = Counter(), 0
                for e in at[x:]:
                    if e - s >= most:
                        break
                    seen[grams[e]] += 1
                    common += seen[grams[e]] <= want[grams[e]]
                    n = e - s + 1
                    span = (2_000_000 * common - 800_000 * (n + size), -n, s, e, common)
                    by_start[s], by_end[e] = max(by_start.get(s, span), span), max(by_end.get(e, span), span)
            for s, span in by_start.items():
                if span[0] >= 0 and by_end[span[3]] == span:
                    hits.setdefault(name, []).append((s, -span[1], k, span[0], round(2 * span[4] / (size - span[1]), 6)))
        for name, found in hits.items():
            runs, end = [], -1
            for h in sorted(found):
                if h[0] >= end:
                    runs.append([])
                runs[-1].append(h)
                end = max(end, h[0] + h[1])
            out += [(doc, name, h[2], h[0], h[4]) for h in (min(r, key=lambda h: (-h[3], h[2], h[0], h[1])) for r in runs)]
    return sorted(out, key=str)


MIT, APACHE = license_scan.TEMPLATES[2][1], license_scan.TEMPLATES[4][1]
PROSE = "It is said that words of many kinds stand in a text, some of the time with reason and some of the time without, as it may be. " * 6


def wrapped(text, width=70, lead=""):
    import textwrap

    return "\n".join(lead + x for x in textwrap.wrap(text, width))


PROBES = [
    ("ISC", "ISC License\n\nCopyright (c) 2011, Some Authors\n\n" + wrapped(WHOLE["ISC"], 78) + "\n"),
    ("Apache-2.0", "package a;\n\n" + wrapped(APACHE, 66, " * ") + "\n\nclass B { int c = 1; }\n" + PROSE),
    ("MIT", wrapped(MIT) + "\n\n" + PROSE),
    ("MIT", PROSE + MIT + " " + PROSE),
    ("MIT", PROSE + "Licensed under the MIT License. " + PROSE),
    ("MIT", MIT),
    ("BSD-3-Clause", PROSE + wrapped(WHOLE["BSD-3-Clause"], 60) + PROSE),
]


def test_licenses_inside_texts(spark):
    """Wrapped, in the middle of other text, within a line: found, and where brute force over all windows finds them."""
    rows = [(i, t) for i, (_, t) in enumerate(PROBES)] + [(100, PROSE), (101, None), (102, ""), (103, "word"), (104, MIT + "\n" + PROSE + MIT), (104, MIT + "\n" + PROSE + MIT), (None, MIT)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as template", "2 as n", "3 as start", "'x' as license")
    got = license_scan.scan_licenses(docs).filter("unit = 'passage'").collect()
    found = sorted(((r["doc_id"], r["license"], r["template"], r["start_word"], r["dice"]) for r in got), key=str)
    assert found == brute_force(list(dict.fromkeys(rows)))
    assert {(i, n) for i, (n, _) in enumerate(PROBES)} <= {(d, n) for d, n, *_ in found}
    assert not [f for f in found if f[0] in (100, 101, 102, 103)] and sum(f[0] == 104 for f in found) == 2


def cut_texts():
    """Each template of 30 words or more: its first 70, 75 and 80 percent, and with every twelfth word replaced."""
    for name, template in license_scan.TEMPLATES:
        w = license_scan.words_of(template)
        if 30 <= len(w) <= 1000:
            for share in (0.7, 0.75, 0.8):
                yield name, " ".join(w[: int(len(w) * share)])
            yield name, " ".join("zebra" if i % 12 == 11 else x for i, x in enumerate(w))


def test_embedding_loses_no_match(spark):
    """What is found alone is found between 200 words of prose on either side, as brute force says."""
    cases = list(cut_texts())
    lead = " ".join(PROSE.split()[:200])
    alone = [(i, t) for i, (_, t) in enumerate(cases)]
    inside = [(i, f"{lead} {t} {lead}") for i, t in alone]
    names = lambda rows: {(r["doc_id"], r["license"]) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = {(i, n) for i, (n, _) in enumerate(cases)}
    assert names(alone) & own <= names(inside) and len(names(alone) & own) > 0.9 * len(own)
    got = license_scan.scan_licenses(spark.createDataFrame(inside, "doc_id long, text string")).filter("unit = 'passage'").collect()
    assert sorted(((r["doc_id"], r["license"], r["template"], r["start_word"], r["dice"]) for r in got), key=str) == brute_force(inside)


def test_repeated_rows_count_once(spark):
    w = license_scan.words_of(WHOLE["BSD-2-Clause"])
    cut = " ".join(x for i, x in enumerate(w) if i % 9)
    rows = lambda n: sorted(map(str, license_scan.scan_licenses(spark.createDataFrame([(1, cut)] * n + [(None, cut)] * n, "doc_id long, text string")).collect()))
    assert rows(1) == rows(2) == rows(3) and rows(1)


def test_whole_texts_inside_others(spark):
    names = sorted(n for n in WHOLE if n not in ("GPL-2.0",))
    rows = [(i, f"{PROSE}\n{WHOLE[n]}\n{PROSE}") for i, n in enumerate(names)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).filter("unit = 'passage'").collect()
    assert {(r["doc_id"], r["license"]) for r in got} >= set(enumerate(names))
