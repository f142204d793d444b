"""License scan: base phrases against a plain word matcher, the method's labels on examples."""

import re
from itertools import islice, product

try:
    from re import _parser
except ImportError:
    import sre_parse as _parser

from tarsia.llm.licenses import BASE, GATE, SPDX, rules, scan_licenses

SCHEMA = "doc_id long, text string, label string"


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


TEXTS = [
    None,
    "",
    "...",
    "CC-BY-NC cc by nc, cc by nc 4.0",
    "Under the MIT License; under the mit licenses under the mit-license",
    "Licensed under the Apache License, Version 2.0.",
    "Apache License Version 20",
    "mit dem Rad, apache",
    "Éa under the MİT license   under the mit license",
    "x " * 50_000 + "cc by nc " * 3000,
    "This work is licensed under the GNU General Public License, version 3.",
    "SPDX-License-Identifier: BSD-3-Clause",
    "dedicated to the public domain, Creative Commons Attribution-ShareAlike 4.0",
]


def test_base_and_method(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], None), (None, "cc by nc", None)]
    got = scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "cc by nc" if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    by = {r.doc_id: r.labels for r in got}
    assert by[10] == "gpl-3" and by[11] == "bsd-3-clause" and by[7] == ""
    assert by[5] == "apache-2" and by[12] == "cc-by-sa-4,public-domain"
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rules_have_keywords():
    assert len(rules()) > 250
    assert all(r.keyword for r in rules())


def samples(parsed):
    """Texts that a pattern matches: each branch, the least repeats first."""
    parts = []
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            parts.append([chr(arg)])
        elif op == "NOT_LITERAL":
            parts.append(["x"])
        elif op == "IN":
            parts.append(["x"] if str(arg[0][0]) == "NEGATE" else [chr(v if str(o) == "LITERAL" else v[0]) for o, v in arg])
        elif op == "BRANCH":
            parts.append([s for b in arg[1] for s in samples(b)])
        elif op == "SUBPATTERN":
            parts.append(samples(arg[3]))
        else:
            assert op == "MAX_REPEAT", op
            once = samples(arg[2])
            parts.append([once[0] * arg[0]] + (once if arg[0] == 0 else []))
    return ["".join(p) for p in islice(product(*parts), 400)]


def test_each_rule_fires(spark):
    rows = []
    for n, r in enumerate(rules()):
        texts = [s for s in samples(_parser.parse(r.pattern)) if r.keyword in f" {s} "]
        assert texts, r
        rows += [(n, texts[0], r.label)]
    rows += [(n, "freebsd", "bsd-2-clause") for n in [len(rules())]]
    got = {x.doc_id: x for x in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not [(n, t, label) for n, t, label in rows if label not in got[n].labels.split(",")]
    assert got[len(rules())].labels == "bsd-2-clause"


def test_spdx_identifiers(spark):
    known = {"MIT": "mit", "ISC": "isc", "Zlib": "zlib", "PostgreSQL": "postgresql", "Ruby": "ruby", "OpenSSL": "openssl", "Vim": "vim", "curl": "curl", "JSON": "json", "X11": "x11", "ICU": "icu", "BSL-1.0": "boost-1", "PSF-2.0": "python-2", "OFL-1.1": "ofl-1", "UPL-1.0": "upl-1", "NCSA": "ncsa", "0BSD": "bsd-0-clause", "MIT-0": "mit-0", "BUSL-1.1": "bsl-1", "GPL-2.0-or-later": "gpl-2", "LGPL-2.1-only": "lgpl-2.1", "AGPL-3.0-only": "agpl-3", "Apache-2.0": "apache-2", "MPL-1.1": "mpl-1.1", "CC-BY-NC-SA-4.0": "cc-by-nc-sa-4", "CC-BY-2.5": "cc-by-2.5", "CC0-1.0": "cc0-1", "PHP-3.01": "php-3"}
    rows = [(n, f"// SPDX-License-Identifier: {i}\nint main", i) for n, i in enumerate(known)]
    got = {x.doc_id: x.labels for x in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    wrong = {i: got[n] for n, i in enumerate(known) if known[i] not in got[n].split(",")}
    assert not wrong
    assert set(SPDX) >= {*known.values()}


def test_gate_is_plain_strings_that_rules_demand():
    assert isinstance(GATE, list) and len(GATE) < 50
    for r in rules():
        texts = [f" {s} " for s in samples(_parser.parse(r.pattern)) if r.keyword in f" {s} "]
        assert texts and all(any(g in t for g in GATE) for t in texts), r


def test_only_ascii_is_lowered(spark):
    texts = ["public domain work", "public domain WORK", "public domain wor\u212a", "M\u0130T LICENSE", "MIT LICENSE \u212a\u0130\u00c9 x"]
    got = {x.doc_id: x for x in scan_licenses(spark.createDataFrame([(n, t, "x") for n, t in enumerate(texts)], SCHEMA)).collect()}
    assert [got[n].labels for n in range(5)] == ["public-domain", "public-domain", "", "", "mit"]
    assert [got[n].n_words for n in range(5)] == [3, 3, 3, 2, 4]
