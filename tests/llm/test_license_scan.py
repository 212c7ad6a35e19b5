import math
from collections import Counter

from pyspark.sql import functions as F

from loadspark.llm import license_scan as L

MIT = "Released under the MIT License."
GPL = "This work is licensed under the GNU General Public License, version 3."


def test_finds_the_planted_lines(spark, sf, documents):
    out = L.scan_licences(documents.withColumn("path", F.concat_ws("/", "source", "doc_id")), "path").collect()
    names = {"MIT License": "MIT", "Apache License": "Apache-2.0", "GNU General": "GPL-3.0", "CC BY-NC": "CC-BY-NC-4.0"}
    for r in out:
        want = {v for k, v in names.items() if k in (r["text"] or "")}
        assert ({r["own_license"]} - {None}) <= want if not want else r["own_license"] in want


def brute(text, weights):
    """Best notice over lines, wrapped runs and the whole text."""
    lines = text.split("\n")
    parts = lines + [" ".join(lines[i : i + L.HEADER_LINES]) for i in range(len(lines))] + [text]
    best = []
    for part in parts:
        tf = Counter(t for t in L.terms_of(part) if t in weights)
        norm = math.sqrt(sum((n * weights[t]) ** 2 for t, n in tf.items()))
        for name, terms in L.NOTICES:
            raw = {t: n * weights[t] for t, n in Counter(terms).items()}
            dot = sum(tf[t] * weights[t] * v for t, v in raw.items())
            if norm:
                best.append((-round(dot / norm / math.sqrt(sum(v * v for v in raw.values())), L.DIGITS), name))
    best = [b for b in best if -b[0] >= L.MIN_COSINE]
    return (min(best)[1], -min(best)[0]) if best else (None, None)


TEXTS = [
    "# Copyright 2020 A\n# Licensed under the Apache License,\n# Version 2.0 (the License); you may not use\n# this file except in compliance with the License.\nimport os",
    "// SPDX-License-Identifier: BSD-3-Clause\nint main;",
    "a text about a license to kill\nand the public",
    f"code\n{MIT}\n{GPL}",
    "Licensed under CC BY 4.0.",
    "Licensed under CC BY-SA 4.0.",
    "nothing at all",
]


def test_cosines_equal_brute_force(frame):
    df = frame([(i, f"d/{i}", t) for i, t in enumerate(TEXTS)], "doc_id long, path string, text string")
    weights = L.term_weights(df)
    for r in L.scan_licences(df, "path").collect():
        name, cosine = brute(r["text"], weights)
        assert r["own_license"] == name, r["text"]
        assert cosine is None or abs(r["cosine"] - cosine) < 1e-5


def test_nearest_directory_wins(frame):
    rows = [
        (1, "LICENSE", MIT), (2, "a/b/LICENSE", GPL), (3, "a/x.py", "code"), (4, "a/b/c/d/y.py", "code"),
        (5, "a/b/z.py", f"code\n{MIT}"), (6, "q/w.py", None), (7, None, "code"), (8, "a/bb/n.py", "code"), (8, "a/bb/n.py", "code"),
    ]
    out = L.scan_licences(frame(rows, "doc_id long, path string, text string"), "path").collect()
    got = {r["doc_id"]: (r["own_license"], r["inherited_license"], r["license"]) for r in out}
    assert len(out) == len(rows)
    assert got == {
        1: ("MIT", None, "MIT"), 2: ("GPL-3.0", None, "GPL-3.0"), 3: (None, "MIT", "MIT"), 4: (None, "GPL-3.0", "GPL-3.0"),
        5: ("MIT", None, "MIT"), 6: (None, "MIT", "MIT"), 7: (None, None, None), 8: (None, "MIT", "MIT"),
    }


def test_odd_rows(odd, empty):
    df = odd.withColumn("path", F.concat_ws("/", "source", "doc_id")).withColumn("license", F.lit("taken"))
    out = L.scan_licences(df, "path", keep=["doc_id", "source"])
    clash = df.withColumns({c: F.lit("taken") for c in L.MADE})
    both = L.scan_licences(clash, "path", keep=["doc_id", *L.MADE])
    assert sorted(both.columns) == sorted(["doc_id", *L.MADE])
    assert both.where("license = 'taken' OR own_license = 'taken'").count() == 0
    assert out.count() == odd.count() and out.where("license IS NOT NULL").count() == 0
    assert L.scan_licences(empty.withColumn("path", F.lit("p")), "path").count() == 0


def body(name):
    """A whole licence text as it is found in a repository, with its title and a copyright line."""
    text = L.files("loadspark.llm").joinpath("licences", f"{name}.txt").read_text("utf-8")
    return f"{name} License\n\nCopyright (c) 2024 Jane Doe and contributors\n\n{text}"


def test_whole_licence_texts_are_licence_files(frame, documents):
    names = [name for name, _ in L.BODIES]
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0"} <= set(names)
    affero = body("GPL-3.0").replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE", 1)
    rows = [(i, f"{n}/LICENSE", body(n)) for i, n in enumerate(names)] + [(100 + i, f"{n}/src/a.py", "code") for i, n in enumerate(names)]
    rows += [(200, "one/LICENSE", " ".join(body("MIT").split())), (201, "one/a.py", "code"), (202, "agpl/LICENSE", affero), (203, "agpl/a.py", "code")]
    prose = [(1000 + r["doc_id"], "prose/x", r["text"]) for r in documents.select("doc_id", "text").limit(100).collect()]
    out = L.scan_licences(frame(rows + prose, "doc_id long, path string, text string"), "path", keep=["doc_id"]).collect()
    got = {r["doc_id"]: (r["own_license"], r["inherited_license"]) for r in out}
    for i, name in enumerate(names):
        assert got[i] == (name, None) and got[100 + i] == (None, name), (name, got[i], got[100 + i])
    assert got[200] == ("MIT", None) and got[201] == (None, "MIT")
    assert got[203] == (None, None)


def test_texts_with_few_rare_terms_cannot_reach_the_cosine():
    weights = {t: 1 + (len(t) * 7 % 5) / 2 for t in L.BODY_TERMS}
    for (_, terms), (rare, need) in zip(L.BODIES, L.rare_terms(weights)):
        squares = {t: (c * weights[t]) ** 2 for t, c in Counter(terms).items()}
        few = sorted((squares[t] for t in rare), reverse=True)[: need - 1]
        others = sum(v for t, v in squares.items() if t not in rare)
        assert need >= 1 and sum(few) + others < L.MIN_COSINE**2 * sum(squares.values())


UNKNOWN = [
    "SPDX-License-Identifier: Zlib", "# SPDX-License-Identifier: BSL-1.0\nimport os", "Released under the Zlib License.",
    "Released under the Foo License.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.",
    "This work is licensed under the GNU General Public License, version 1.", "Licensed under the Boost License, Version 1.0.",
    "Licensed under the Eclipse Public License, Version 2.0.",
]


def test_other_licences_are_not_taken_for_known_ones(frame):
    # mit, by and under are frequent words here, as in German and English prose.
    rows = [(i, f"d/{i}", text) for i, text in enumerate(UNKNOWN)] + [(1000 + i, "p/x", "es geht mit dem Zug by the way and under it") for i in range(200)]
    affero = next(" ".join(terms) for name, terms in L.NOTICES if name == "AGPL-3.0" and "redistribute" in terms)
    rows += [(100, "a/1", affero), (101, "a/2", "SPDX-License-Identifier: MIT"), (102, "a/3", "Released under the MIT License.")]
    out = L.scan_licences(frame(rows, "doc_id long, path string, text string"), "path", keep=["doc_id"]).collect()
    got = {r["doc_id"]: r["own_license"] for r in out}
    assert [UNKNOWN[i] for i in range(len(UNKNOWN)) if got[i]] == []
    assert (got[100], got[101], got[102]) == ("AGPL-3.0", "MIT", "MIT")


def test_norms_count_all_terms(frame):
    """The cosine of a line is that of all its terms, not only of those in the statements."""
    text = "Released under the MIT License by Quux"
    rows = [(1, "d/1", text)] + [(2 + i, "p/x", "es geht mit dem Zug") for i in range(20)]
    df = frame(rows, "doc_id long, path string, text string")
    weights = L.term_weights(df, "text", sorted(set(L.terms_of(text))))
    notice = L.terms_of("Released under the MIT License.")
    own = math.sqrt(sum(v * v for v in weights.values()))
    [near] = L._cosines(
        df.where("doc_id = 1").select(F.lit("k").alias("key"), L.text_terms(F.col("text")).alias("terms")),
        L.NOTICES, L.term_weights(df), L.vocabulary(df), df.count(), L.NAMED,
    ).where("license = 'MIT'").collect()
    assert abs(near["cosine"] - math.sqrt(sum(weights[t] ** 2 for t in notice)) / own) < 1e-5


def test_notices_are_found_however_lines_are_cut(frame):
    long = next((name, text) for name, text in L.TEMPLATES if name == "GPL-3.0" and "redistribute" in text)
    prose = ("the ship of the line went to the sea and to a harbour of the king " * 40).split()
    rows, want = [], {}
    for name, text in [long, ("MIT", MIT), L.TEMPLATES[1]]:
        words = text.split()
        for n in range(1, 9):
            size = -(-len(words) // n)
            wrapped = "\n".join(" * " + " ".join(words[i : i + size]) for i in range(0, len(words), size))
            rows.append((len(rows), f"a/{len(rows)}", f"int a;\n{wrapped}\nint main;"))
            want[len(want)] = name
        rows.append((len(rows), f"a/{len(rows)}", " ".join(prose[:250] + words + prose[:250])))
        want[len(want)] = name
        rows.append((len(rows), f"a/{len(rows)}", "\n".join(prose[:250] + words + prose[:250])))
        want[len(want)] = name
    rows.append((len(rows), "a/none", " ".join(prose)))
    want[len(want)] = None
    out = L.scan_licences(frame(rows, "doc_id long, path string, text string"), "path", keep=["doc_id"]).collect()
    assert {r["doc_id"]: r["own_license"] for r in out} == want
    assert all(r["cosine"] == 1.0 for r in out if r["own_license"])
