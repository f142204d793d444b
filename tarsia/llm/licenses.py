"""License detection by ordered signature rules. DataFrame functions only.

Rules are regular expressions over a text's words, lower-cased and single-spaced. A cheap
keyword gate picks the texts worth a look and, in these, the rules whose own keyword
occurs. Detections are word intervals; one that lies within an interval of the same or a
higher priority is dropped.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, scratch

#: The only character beyond ASCII whose lower case is one of ASCII, and a letter that stands in for it.
KELVIN, LETTER = "\u212a", "\u00e5"
#: Everything that isn't a digit, a lower-case letter or beyond ASCII separates words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed phrases, found at all places, never suppressed.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BARE, NAMED, GRANT, FIXED = 1, 2, 3, 4
SCORES = {BARE: 0.4, NAMED: 0.7, GRANT: 0.9, FIXED: 1.0}


@dataclass(frozen=True)
class Rule:
    """A pattern over whole words, the keyword that must occur for it to be tried, and what it says."""

    label: str
    pattern: str
    keyword: str
    priority: int


L = "licen[cs]e"
#: label, name as a pattern, keyword: a substring of all that the pattern matches
NAMES: list[tuple[str, str, str]] = [
    ("mit", f"mit {L}", "mit licen"),
    ("mit", "expat licen[cs]e", "expat"),
    ("mit-0", "mit (?:no attribution|0)", "mit "),
    ("isc", f"isc {L}", "isc licen"),
    ("bsd-0-clause", f"(?:0bsd|zero clause bsd)(?: {L})?", "bsd"),
    ("bsd-2-clause", f"(?:(?:bsd )?(?:2|two) clause(?: bsd)?|simplified bsd|freebsd)(?: {L})?", "bsd"),
    ("bsd-3-clause", f"(?:(?:bsd )?(?:3|three) clause(?: bsd)?|modified bsd|new bsd|revised bsd)(?: {L})?", "bsd"),
    ("bsd-4-clause", f"(?:(?:bsd )?(?:4|four) clause(?: bsd)?|original bsd)(?: {L})?", "bsd"),
    ("unlicense", "(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("wtfpl", "do what the f[^ ]+ you want to public licen[cs]e", "do what the"),
    ("zlib", f"zlib(?: libpng)? {L}", "zlib"),
    ("boost-1", f"boost software {L}(?: version)?(?: v?1(?: 0)?)?", "boost"),
    ("postgresql", f"postgresql {L}", "postgresql"),
    ("python-2", "(?:python software foundation|psf) licen[cs]e(?: agreement)?(?: for python| version 2)*", "licen"),
    ("php-3", f"php {L}(?: version)?(?: v?3(?: 0[01]?)?)?", "php"),
    ("ruby", f"ruby {L}", "ruby"),
    ("openssl", f"openssl {L}", "openssl"),
    ("vim", f"vim {L}", "vim"),
    ("curl", f"curl {L}", "curl"),
    ("libpng-2", f"libpng {L}(?: version 2)?", "libpng"),
    ("ncsa", f"(?:university of illinois )?ncsa (?:open source )?{L}", "ncsa"),
    ("json", f"json {L}", "json licen"),
    ("beerware", f"(?:beerware|beer ware)(?: {L})?", "beer"),
    ("x11", f"x11 {L}", "x11"),
    ("w3c", f"w3c (?:software )?(?:notice and )?{L}", "w3c"),
    ("unicode", f"unicode {L}(?: agreement| v3)?", "unicode licen"),
    ("icu", f"icu {L}", "icu licen"),
    ("upl-1", f"universal permissive {L}", "universal permissive"),
    ("bsl-1", "business source licen[cs]e", "business source"),
    ("sspl-1", "server side public licen[cs]e", "server side public"),
    ("sspl-1", "sspl", "sspl"),
    ("elastic-2", f"elastic {L}(?: 2(?: 0)?)?", "elastic licen"),
    ("commons-clause", "commons clause(?: licen[cs]e condition)?", "commons clause"),
    ("ms-pl", "microsoft public licen[cs]e", "microsoft public"),
    ("ms-pl", "ms pl", " ms pl "),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "microsoft reciprocal"),
    ("ms-rl", "ms rl", " ms rl "),
    ("artistic-1", "artistic licen[cs]e(?: version)? v?1(?: 0)?", "artistic"),
    ("artistic-2", "artistic licen[cs]e(?: version)? v?2(?: 0)?", "artistic"),
    ("ofl-1", "(?:sil )?open font licen[cs]e", "open font"),
    ("odbl-1", "open database licen[cs]e", "open database"),
    ("odbl-1", "odbl", "odbl"),
    ("odc-by-1", "open data commons attribution(?: licen[cs]e)?", "open data commons"),
    ("pddl-1", "(?:open data commons )?public domain dedication and licen[cs]e", "public domain"),
    ("public-domain", "(?:(?:in|into|to) the public domain|public domain (?:work|dedication))", "public domain"),
    ("cc0-1", "cc0(?: 1 0)?(?: universal)?", "cc0"),
    ("cc0-1", "(?:cc|creative commons) zero(?: 1 0)?(?: universal)?", " zero"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("proprietary", f"(?:proprietary|commercial) {L}", "licen"),
    ("eula", f"end user {L} agreement", "end user"),
    ("gfdl", "gnu free documentation licen[cs]e", "free documentation"),
    ("openrail", "(?:creativeml )?open ?rail(?: m)?(?: licen[cs]e)?", "rail"),
    ("llama", f"llama [0-9 ]*community {L}", "llama"),
]


def _versioned(label: str, names: dict[str, str], *versions: str) -> None:
    """A family: each version, for each keyword and the name it stands for."""
    for v in versions:
        tail = "" if "." in v else "(?: 0)?"
        for keyword, name in names.items():
            NAMES.append((f"{label}-{v}", f"{name}(?: licen[cs]e)?(?: version| v| ver)? ?v?{v.replace('.', ' ')}{tail}", keyword))


_versioned("gpl", {"general public": f"(?:gnu )?general public {L}", "gpl": "(?:gnu )?gpl"}, "1", "2", "3")
_versioned("lgpl", {"general public": f"(?:gnu )?(?:lesser|library) general public {L}", "lgpl": "(?:gnu )?lgpl"}, "2", "2.1", "3")
_versioned("agpl", {"affero general": f"(?:gnu )?affero general public {L}", "agpl": "(?:gnu )?agpl"}, "1", "3")
_versioned("apache", {"apache": "apache(?: software)?"}, "1", "1.1", "2")
_versioned("mpl", {"mozilla public": f"mozilla public {L}", " mpl": "mpl"}, "1", "1.1", "2")
_versioned("epl", {"eclipse public": f"eclipse public {L}", " epl": "epl"}, "1", "2")
_versioned("cddl", {"common development": "common development and distribution", "cddl": "cddl"}, "1", "1.1")
_versioned("eupl", {"european union public": f"european union public {L}", "eupl": "eupl"}, "1.1", "1.2")
_versioned("cecill", {"cecill": "cecill"}, "1", "2", "2.1")
_versioned("osl", {"open software": "open software", " osl": "osl"}, "1", "2", "3")
_versioned("afl", {"academic free": "academic free", " afl": "afl"}, "1", "2", "3")
#: Creative Commons: elements in the short and the long form
CC = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s?", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
for _short, _long in CC.items():
    _forms = {f" {_short.replace('-', ' ')}": f"(?:cc|creative commons) {_short.replace('-', ' ')}", "creative commons attribution": f"creative commons {_long}"}
    _versioned(f"cc-{_short}", _forms, "1", "2", "2.5", "3", "4")
    for _keyword, _name in _forms.items():
        NAMES.append((f"cc-{_short}", f"{_name}(?: {L})?", _keyword))
#: Names without a version, which say less.
FAMILIES = [("gpl", f"(?:gnu )?general public {L}", "general public"), ("gpl", "gpl", " gpl "), ("lgpl", f"lesser general public {L}", "lesser general"), ("lgpl", "lgpl", " lgpl "), ("agpl", f"affero general public {L}", "affero"), ("agpl", "agpl", " agpl "), ("apache", f"apache(?: software)? {L}", "apache"), ("mpl", f"mozilla public {L}", "mozilla"), ("epl", f"eclipse public {L}", "eclipse"), ("bsd", f"bsd(?: style)? {L}", "bsd"), ("creative-commons", f"creative commons(?: {L})?", "creative commons"), ("artistic", f"artistic {L}", "artistic")]
#: SPDX identifiers as words, which unlike the names don't say "license"
SPDX = {
    "mit": "mit", "mit-0": "mit 0", "isc": "isc", "bsd-0-clause": "0bsd", "bsd-2-clause": "bsd 2 clause", "bsd-3-clause": "bsd 3 clause", "bsd-4-clause": "bsd 4 clause", "unlicense": "unlicense",
    "wtfpl": "wtfpl", "zlib": "zlib", "boost-1": "bsl 1 0", "postgresql": "postgresql", "python-2": "(?:psf|python) 2 0", "php-3": "php 3 01?", "ruby": "ruby", "openssl": "openssl", "vim": "vim", "curl": "curl",
    "libpng-2": "libpng 2 0", "ncsa": "ncsa", "json": "json", "beerware": "beerware", "x11": "x11", "w3c": "w3c", "unicode": "unicode (?:3 0|dfs 201[56]|tou)", "icu": "icu", "upl-1": "upl 1 0", "bsl-1": "busl 1 1",
    "sspl-1": "sspl 1 0", "elastic-2": "elastic 2 0", "ms-pl": "ms pl", "ms-rl": "ms rl", "artistic-1": "artistic 1 0", "artistic-2": "artistic 2 0", "ofl-1": "ofl 1 [01]", "odbl-1": "odbl 1 0",
    "odc-by-1": "odc by 1 0", "pddl-1": "pddl 1 0", "cc0-1": "cc0 1 0", "gfdl": "gfdl 1 [123]",
}
for _label in dict.fromkeys(label for label, _, _ in NAMES):
    # families: the version is written with a minor number
    if _label.rsplit("-", 1)[0] in ("gpl", "lgpl", "agpl", "apache", "mpl", "epl", "cddl", "eupl", "cecill", "osl", "afl", *(f"cc-{c}" for c in CC)) and _label not in CC:
        _family, _version = _label.rsplit("-", 1)
        if _version[0].isdigit():
            SPDX[_label] = f"{_family} {_version if '.' in _version else _version + '.0'}".replace("-", " ").replace(".", " ")
GIVEN = f"(?:licen[cs]ed|released|distributed|available|published|provided|covered|redistribute(?: it)?(?: and or modify it)?)(?: [^ ]+){{0,3}} (?:under|by)(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the)?(?: an?)?"


def rules() -> list[Rule]:
    """In order: fixed phrases, grants and identifiers, names, bare families."""
    out = [Rule(label, phrase, phrase, FIXED) for phrase, label in BASE.items()]
    out += [Rule(label, f"{GIVEN} {name}(?: or (?:any )?later(?: version)?)?", k, GRANT) for label, name, k in NAMES]
    out += [Rule(label, f"spdx {L} identifier {name}(?: only| or later)?", "spdx", GRANT) for label, name, _ in NAMES]
    out += [Rule(label, f"spdx {L} identifier {name}(?: only| or later)?", "spdx", GRANT) for label, name in SPDX.items()]
    out += [Rule(label, name, k, NAMED) for label, name, k in NAMES]
    return out + [Rule(label, name, k, BARE) for label, name, k in FAMILIES]


#: For keywords that many texts hold, what the rules with that keyword demand.
DEMAND = {"mit ": [" mit "], "rail": ["openrail", "open rail"], "beer": ["beerware", "beer ware"], " zero": ["cc zero", "creative commons"]} | {f" {c.replace('-', ' ')}": [f"cc {c.replace('-', ' ')}", "creative commons"] for c in CC}


def _gate() -> list[str]:
    """A text that holds none of these has no license statement."""
    # what must be there stays of a pattern: optional groups go, innermost first
    demanded = set()
    for pattern, keyword in [(r.pattern, r.keyword) for r in rules() if r.priority == FIXED] + [(p, k) for _, p, k in [*NAMES, *FAMILIES]] + [("spdx", "spdx")]:
        while (less := re.sub(r"\(\?:[^()]*\)[?*]", "", pattern)) != pattern:
            pattern = less
        demanded.update(["licenc", "licens"] if L in pattern or "license" in pattern else DEMAND.get(keyword, [keyword]))
    # those that hold another one add nothing
    return sorted(d for d in demanded if not any(o != d and o in d for o in demanded))


GATE = _gate()


def _spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def scan_licenses(docs: DataFrame, more: tuple[Rule, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, detections (label, priority, start and end word of what was kept).

    Null and empty texts have no words and no labels, and score 0. Repeated rows are
    returned as often as they come; null ids are allowed; an empty table gives an empty
    result; other columns are ignored. The score is that of the strongest detection.
    """
    spark = docs.sparkSession
    path = scratch(spark, "licenses")
    flat = F.btrim(F.regexp_replace(F.lower(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(KELVIN), F.lit(LETTER))), BETWEEN, " "), F.lit(" "))
    words = docs.select(F.col(id_col).alias("doc_id"), F.concat(F.lit(" "), flat, F.lit(" ")).alias("s"))
    n_words = F.when(F.col("s") == "  ", 0).otherwise(_spaces(F.col("s")) - 1).cast("long")
    gate = reduce(operator.or_, [F.contains(F.col("s"), F.lit(k)) for k in GATE])
    given = F.when(gate, F.col("s").rlike(f" {GIVEN}"))
    seen = save(words.select(F.monotonically_increasing_id().alias("rid"), "doc_id", n_words.alias("n_words"), F.when(gate, F.col("s")).alias("s"), given.alias("given")), f"{path}/seen")

    # each keyword is looked for once; rules for grants are tried where the words that grant occur
    groups: dict[tuple[str, bool], list[Rule]] = {}
    for r in [*rules(), *more]:
        groups.setdefault((r.keyword, r.pattern.startswith(GIVEN)), []).append(r)
    each = lambda r: F.struct(F.lit(r.label).alias("label"), F.lit(f"(?<= )(?:{r.pattern})(?= )").alias("pattern"), F.lit(r.priority).alias("priority"))
    grouped = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(g).alias("given"), F.array(*map(each, rs)).alias("rules")) for (k, g), rs in groups.items()])
    held = F.filter(grouped, lambda g: (~g["given"] | F.col("given")) & F.contains(F.col("s"), g["keyword"]))
    tried = F.filter(F.flatten(F.transform(held, lambda g: g["rules"])), lambda r: F.regexp_like(F.col("s"), r["pattern"]))
    hit = seen.where("s is not null").select("rid", "s", F.posexplode(tried).alias("k", "rule"))
    gaps, hits = F.split("s", F.col("rule.pattern"), -1), F.regexp_extract_all("s", F.col("rule.pattern"), F.lit(0))
    # words before each match since the one before, and words of the match
    spans = hit.select("rid", "k", "rule.label", "rule.priority", F.posexplode(F.arrays_zip(F.transform(gaps, lambda g: _spaces(g) - 1).alias("gap"), F.transform(hits, lambda h: _spaces(h) + 1).alias("len"))).alias("i", "w"))
    spans = spans.where("w.len is not null")
    before = Window.partitionBy("rid", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.select("rid", "label", "priority", (F.sum(F.col("w.gap") + F.col("w.len")).over(before)).alias("end"), F.col("w.len").alias("len"))
    spans = spans.select("rid", "label", "priority", (F.col("end") - F.col("len")).alias("start"), "end").distinct()
    # containment: rows before in this order may hold the interval
    order = Window.partitionBy("rid").orderBy("start", F.desc("end"), F.desc("priority"), "label").rowsBetween(Window.unboundedPreceding, -1)
    for p in (BARE, NAMED, GRANT, FIXED):
        spans = spans.withColumn(f"reach{p}", F.max(F.when(F.col("priority") >= p, F.col("end"))).over(order))
    reach = F.element_at(F.array(*[F.col(f"reach{p}") for p in (BARE, NAMED, GRANT, FIXED)]), F.col("priority"))
    kept = spans.where((F.col("priority") == FIXED) | reach.isNull() | (reach < F.col("end")))
    score = F.element_at(F.array(*[F.lit(SCORES[p]) for p in (BARE, NAMED, GRANT, FIXED)]), F.col("priority"))
    base = F.col("priority") == FIXED
    found = kept.groupBy("rid").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(score).alias("score"),
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "priority"))).alias("detections"),
    )
    none = F.lit("")
    return seen.drop("s", "given").join(found, "rid", "left").select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"), F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "detections")
