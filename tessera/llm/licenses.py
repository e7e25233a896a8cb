"""License scans by ordered signature rules, with DataFrame functions only.

A rule is a hand-written regular expression over words (a text in lower case, its words joined by one space), with
keywords of which a text must hold one for the expression to run at all, a priority and a label. ``RULES`` lists 79 licenses by
name, identifier and address, all written by hand; each yields up to four rules in order of priority: an SPDX tag, an address, a notice
("licensed under the ..."), and the bare title. A text without any of the ``GATE`` words, of which each rule implies one, is only counted. Texts that
pass are joined once and written, so that rules and base phrases read the same rows whatever becomes of an executor.

Detections are intervals of characters. One that lies inside a detection of the same or a higher priority is
suppressed; intervals are swept in order of their start, with the furthest end so far for each priority, so a text with many
detections costs its number of them times four. Base phrases are counted apart and never suppressed.

Edge cases. Null or empty text: no words, no places, score 0, labels empty. Null id: a row like any other. Repeated rows: a
result each. Very long texts: whole. Ties (two rules on one interval): the higher priority, then the earlier rule, stays; a
label counts once however many rules find it. No rows: no rows. Extra columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import keep

#: A word before A-Z count as a-z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: A text with none of these holds nothing that a rule could find: each rule's expression implies one of them.
GATE = ("licen", "copyright", "domain", "attribution", "commons", "reserved", "proprietary", "unencumbered", "freebsd", "mozilla", "eclipse", "mariadb", "vimdoc", "joinup", "affero")
GATE_WORDS = r"(?:^|[\x00-\x2F\x3A-\x60\x7B-\x7F])(?:[al]?gpl|cc0|0?bsd|wtfpl|ofl)"
CONFIDENCE = (1.0, 0.95, 0.9, 0.6)

# label, SPDX identifier in words, address in words, title (a regular expression over words), keywords of the title (each of its alternatives holds one)
RULES: list[tuple[str, str, str, str, str]] = [
    ("mit", "mit", "opensource org licenses mit", r"mit licen[cs]e|expat licen[cs]e|x11 licen[cs]e", "licen"),
    ("mit-0", "mit 0", "opensource org licenses mit 0", r"mit no attribution( licen[cs]e)?", "no attribution"),
    ("apache-2.0", "apache 2 0", "apache org licenses license 2 0", r"apache (software )?licen[cs]e( version| v)? ?2( 0)?", "apache"),
    ("apache-1.1", "apache 1 1", "apache org licenses license 1 1", r"apache (software )?licen[cs]e( version| v)? ?1 1", "apache"),
    ("apache-1.0", "apache 1 0", "apache org licenses license 1 0", r"apache (software )?licen[cs]e( version| v)? ?1 0", "apache"),
    ("gpl-1.0", "gpl 1 0( only| or later)?", "gnu org licenses old licenses gpl 1 0", r"gnu general public licen[cs]e( version| v) ?1\b|gpl ?v?1( 0)?\b", "general public|gpl"),
    ("gpl-2.0", "gpl 2 0( only| or later)?", "gnu org licenses (old licenses )?gpl 2 0", r"gnu general public licen[cs]e( version| v) ?2\b|gpl ?v?2( 0)?\b", "general public|gpl"),
    ("gpl-3.0", "gpl 3 0( only| or later)?", "gnu org licenses gpl( 3 0)?", r"gnu general public licen[cs]e( version| v) ?3\b|gpl ?v?3( 0)?\b", "general public|gpl"),
    ("lgpl-2.0", "lgpl 2 0( only| or later)?", "gnu org licenses old licenses lgpl 2 0", r"gnu library general public licen[cs]e( version| v)? ?2( 0)?|lgpl ?v?2( 0)?\b", "library general|lgpl"),
    ("lgpl-2.1", "lgpl 2 1( only| or later)?", "gnu org licenses (old licenses )?lgpl 2 1", r"gnu lesser general public licen[cs]e( version| v) ?2 1|lgpl ?v?2 1\b", "lesser general|lgpl"),
    ("lgpl-3.0", "lgpl 3 0( only| or later)?", "gnu org licenses lgpl( 3 0)?", r"gnu lesser general public licen[cs]e( version| v) ?3|lgpl ?v?3( 0)?\b", "lesser general|lgpl"),
    ("agpl-1.0", "agpl 1 0( only| or later)?", "affero org oagpl", r"affero general public licen[cs]e( version| v)? ?1\b", "affero"),
    ("agpl-3.0", "agpl 3 0( only| or later)?", "gnu org licenses agpl( 3 0)?", r"gnu affero general public licen[cs]e( version| v)? ?3?|agpl ?v?3( 0)?\b", "affero|agpl"),
    ("gfdl-1.1", "gfdl 1 1( only| or later)?", "gnu org licenses old licenses fdl 1 1", r"gnu free documentation licen[cs]e( version| v) ?1 1", "documentation"),
    ("gfdl-1.2", "gfdl 1 2( only| or later)?", "gnu org licenses old licenses fdl 1 2", r"gnu free documentation licen[cs]e( version| v) ?1 2", "documentation"),
    ("gfdl-1.3", "gfdl 1 3( only| or later)?", "gnu org licenses fdl( 1 3)?", r"gnu free documentation licen[cs]e( version| v) ?1 3", "documentation"),
    ("bsd-1-clause", "bsd 1 clause", "opensource org licenses bsd 1 clause", r"bsd (1|one) clause( licen[cs]e)?", "bsd"),
    ("bsd-2-clause", "bsd 2 clause", "opensource org licenses bsd 2 clause", r"(bsd (2|two) clause|(2|two) clause bsd|simplified bsd|freebsd)( licen[cs]e)?", "bsd"),
    ("bsd-3-clause", "bsd 3 clause", "opensource org licenses bsd 3 clause", r"(bsd (3|three) clause|(3|three) clause bsd|(new|revised|modified) bsd)( licen[cs]e)?", "bsd"),
    ("bsd-4-clause", "bsd 4 clause", "directory fsf org wiki license bsd 4clause", r"(bsd (4|four) clause|(4|four) clause bsd|original bsd)( licen[cs]e)?", "bsd"),
    ("0bsd", "0bsd", "opensource org licenses 0bsd", r"(bsd zero clause|zero clause bsd)( licen[cs]e)?", "bsd"),
    ("isc", "isc", "opensource org licenses isc", r"isc licen[cs]e", "isc"),
    ("mpl-1.0", "mpl 1 0", "mozilla org mpl mpl 1 0", r"mozilla public licen[cs]e( version| v) ?1 0", "mozilla"),
    ("mpl-1.1", "mpl 1 1", "mozilla org mpl mpl 1 1", r"mozilla public licen[cs]e( version| v) ?1 1", "mozilla"),
    ("mpl-2.0", "mpl 2 0", "mozilla org (en us )?mpl 2 0", r"mozilla public licen[cs]e( version| v)? ?2( 0)?", "mozilla"),
    ("epl-1.0", "epl 1 0", "eclipse org legal epl v10", r"eclipse public licen[cs]e( version| v)? ?1( 0)?", "eclipse"),
    ("epl-2.0", "epl 2 0", "eclipse org legal epl (2 0|v20)", r"eclipse public licen[cs]e( version| v)? ?2( 0)?", "eclipse"),
    ("edl-1.0", "edl 1 0", "eclipse org org documents edl v10", r"eclipse distribution licen[cs]e( version| v)? ?1( 0)?", "eclipse"),
    ("cddl-1.0", "cddl 1 0", "opensource org licenses cddl( 1 0)?", r"common development and distribution licen[cs]e( version| v)? ?1( 0)?", "distribution"),
    ("cddl-1.1", "cddl 1 1", "oss oracle com licenses cddl 1 1", r"common development and distribution licen[cs]e( version| v)? ?1 1", "distribution"),
    ("cpl-1.0", "cpl 1 0", "opensource org licenses cpl 1 0", r"common public licen[cs]e( version| v)? ?1( 0)?", "common public"),
    ("cpal-1.0", "cpal 1 0", "opensource org licenses cpal 1 0", r"common public attribution licen[cs]e( version| v)?( 1 0)?", "attribution"),
    ("cc0-1.0", "cc0 1 0", "creativecommons org publicdomain zero 1 0", r"cc0( 1 0)?( universal)?|creative commons zero( v1 0)?( universal)?", "cc0|commons zero"),
    ("cc-pdm-1.0", "cc pdm 1 0", "creativecommons org publicdomain mark 1 0", r"public domain mark( 1 0)?", "public domain"),
    ("cc-by-2.0", "cc by 2 0", "creativecommons org licenses by 2 0", r"creative commons attribution 2 0( generic)?( licen[cs]e)?", "creative commons"),
    ("cc-by-2.5", "cc by 2 5", "creativecommons org licenses by 2 5", r"creative commons attribution 2 5( generic)?( licen[cs]e)?", "creative commons"),
    ("cc-by-3.0", "cc by 3 0", "creativecommons org licenses by 3 0", r"creative commons attribution 3 0( unported)?( licen[cs]e)?", "creative commons"),
    ("cc-by-4.0", "cc by 4 0", "creativecommons org licenses by 4 0", r"creative commons attribution 4 0( international)?( licen[cs]e)?", "creative commons"),
    ("cc-by-sa-2.0", "cc by sa 2 0", "creativecommons org licenses by sa 2 0", r"creative commons attribution share ?alike 2 0( generic)?( licen[cs]e)?", "creative commons"),
    ("cc-by-sa-3.0", "cc by sa 3 0", "creativecommons org licenses by sa 3 0", r"creative commons attribution share ?alike 3 0( unported)?( licen[cs]e)?", "creative commons"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "creativecommons org licenses by sa 4 0", r"creative commons attribution share ?alike 4 0( international)?( licen[cs]e)?", "creative commons"),
    ("cc-by-nc-3.0", "cc by nc 3 0", "creativecommons org licenses by nc 3 0", r"creative commons attribution non ?commercial 3 0( unported)?( licen[cs]e)?", "creative commons"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "creativecommons org licenses by nc 4 0", r"creative commons attribution non ?commercial 4 0( international)?( licen[cs]e)?", "creative commons"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "creativecommons org licenses by nd 4 0", r"creative commons attribution no ?derivatives 4 0( international)?( licen[cs]e)?", "creative commons"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", "creativecommons org licenses by nc sa 4 0", r"creative commons attribution non ?commercial share ?alike 4 0( international)?( licen[cs]e)?", "creative commons"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", "creativecommons org licenses by nc nd 4 0", r"creative commons attribution non ?commercial no ?derivatives 4 0( international)?( licen[cs]e)?", "creative commons"),
    ("unlicense", "unlicense", "unlicense org", r"the unlicense|free and unencumbered software released into the public domain", "the unlicense|unencumbered"),
    ("wtfpl", "wtfpl", "wtfpl net", r"do what the fuck you want to public licen[cs]e|wtfpl", "you want to public|wtfpl"),
    ("zlib", "zlib", "zlib net zlib license", r"zlib licen[cs]e", "zlib"),
    ("libpng", "libpng( 2 0)?", "libpng org pub png src libpng license", r"libpng licen[cs]e", "libpng"),
    ("bsl-1.0", "bsl 1 0", "boost org license 1 0", r"boost software licen[cs]e( version| v)?( 1 0)?", "boost"),
    ("busl-1.1", "busl 1 1", "mariadb com bsl11", r"business source licen[cs]e( version| v)?( 1 1)?", "business source"),
    ("sspl-1.0", "sspl 1 0", "mongodb com licensing server side public license", r"server side public licen[cs]e( version| v)?( 1)?", "server side"),
    ("elastic-2.0", "elastic 2 0", "elastic co licensing elastic license", r"elastic licen[cs]e( version| v)?( 2 0)?", "elastic"),
    ("artistic-1.0", "artistic 1 0( perl)?", "opensource org licenses artistic 1 0", r"artistic licen[cs]e( version| v)? ?1( 0)?", "artistic"),
    ("artistic-2.0", "artistic 2 0", "opensource org licenses artistic 2 0", r"artistic licen[cs]e( version| v)? ?2( 0)?", "artistic"),
    ("afl-3.0", "afl 3 0", "opensource org licenses afl 3 0", r"academic free licen[cs]e( version| v)?( 3 0)?", "academic free"),
    ("osl-3.0", "osl 3 0", "opensource org licenses osl 3 0", r"open software licen[cs]e( version| v)?( 3 0)?", "open software"),
    ("ofl-1.1", "ofl 1 1", "scripts sil org ofl", r"sil open font licen[cs]e( version| v)?( 1 1)?", "open font"),
    ("ms-pl", "ms pl", "opensource org licenses ms pl", r"microsoft public licen[cs]e", "microsoft"),
    ("ms-rl", "ms rl", "opensource org licenses ms rl", r"microsoft reciprocal licen[cs]e", "microsoft"),
    ("eupl-1.1", "eupl 1 1", "joinup ec europa eu software page eupl", r"european union public licen[cs]e( version| v)? ?1 1", "european union"),
    ("eupl-1.2", "eupl 1 2", "joinup ec europa eu collection eupl", r"european union public licen[cs]e( version| v)? ?1 2", "european union"),
    ("cecill-2.1", "cecill 2 1", "cecill info licences licence cecill v2 1", r"cecill( free software)? licen[cs]e( agreement)?", "cecill"),
    ("psf-2.0", "psf 2 0", "docs python org 3 license", r"python software foundation licen[cs]e( version| v)?( 2)?", "python"),
    ("python-2.0", "python 2 0", "opensource org licenses python 2 0", r"python licen[cs]e( version| v)? ?2( 0)?", "python"),
    ("ruby", "ruby", "ruby lang org en about license", r"ruby licen[cs]e", "ruby"),
    ("php-3.01", "php 3 01", "php net license 3 01", r"php licen[cs]e( version| v)?( 3 01)?", "php"),
    ("openssl", "openssl", "openssl org source license", r"openssl licen[cs]e", "openssl"),
    ("postgresql", "postgresql", "postgresql org about licen[cs]e", r"postgresql licen[cs]e", "postgresql"),
    ("ncsa", "ncsa", "opensource org licenses ncsa", r"university of illinois (ncsa )?open source licen[cs]e", "illinois"),
    ("upl-1.0", "upl 1 0", "opensource org licenses upl", r"universal permissive licen[cs]e( version| v)?( 1 0)?", "permissive"),
    ("vim", "vim", "vimdoc sourceforge net htmldoc uganda", r"vim licen[cs]e", "vim"),
    ("w3c", "w3c", "w3 org consortium legal copyright software", r"w3c software( and document)? (notice and )?licen[cs]e", "w3c"),
    ("odbl-1.0", "odbl 1 0", "opendatacommons org licenses odbl", r"open (data commons open )?database licen[cs]e", "database"),
    ("odc-by-1.0", "odc by 1 0", "opendatacommons org licenses by", r"open data commons attribution licen[cs]e", "data commons"),
    ("pddl-1.0", "pddl 1 0", "opendatacommons org licenses pddl", r"public domain dedication and licen[cs]e", "dedication"),
    ("blueoak-1.0.0", "blueoak 1 0 0", "blueoakcouncil org license 1 0 0", r"blue oak model licen[cs]e", "blue oak"),
    ("proprietary", "", "", r"all rights reserved|proprietary and confidential", "rights reserved|proprietary and"),
]
_TAG, _NOTICE = r"spdx license identifier", r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:the )?"


def rules() -> list[tuple[int, int, str, str, str]]:
    """(rule, priority, label, keywords by |, expression), the strongest priority first; expressions match whole words."""
    out = []
    for label, tag, address, title, keyword in RULES:
        edge = rf"(?<= )(?:{title})(?= )"
        made = [(0, "spdx", rf"(?<= ){_TAG} (?:{tag})(?= )") if tag else None, (1, address.split(" ")[0], rf"(?<= )(?:{address})(?= )") if address else None, (2, keyword, rf"(?<= ){_NOTICE}(?:{title})(?= )"), (3, keyword, edge)]
        out += [(priority, label, key, expression) for priority, key, expression in filter(None, made)]
    return [(n, *r) for n, r in enumerate(sorted(out, key=lambda r: r[0]))]


def words_joined(text: Column) -> Column:
    """The words of a text, A-Z as a-z, each followed by one space and the first preceded by one."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.regexp_replace(F.concat(F.regexp_replace(lower, f"^{GAP}", ""), F.lit(" ")), GAP, " "))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def gated(text: Column) -> Column:
    """Whether a text can hold what any rule finds, by the words that the rules see."""
    lower = F.lower(text)
    hit = lower.rlike(GATE_WORDS)
    for word in GATE:
        hit = F.contains(lower, F.lit(word)) | hit
    return hit


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, and ``detections`` (label, priority, rule,
    start and stop in characters of the joined words) for every row."""
    raw = F.coalesce(F.col(text), F.lit(""))
    joined = keep(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.regexp_count(raw, F.lit(WORD)).cast("long").alias("n_words"), F.when(gated(raw), words_joined(raw)).alias("joined")))

    # base phrases: the text between places, cut at each of them
    counted = joined
    parts = []
    for label, phrase in BASE.items():
        pieces = F.split(F.col("joined"), f"(?<= ){phrase}(?= )", -1)
        counted = counted.withColumn(f"p_{label}", pieces)
        n = F.coalesce(F.size(f"p_{label}") - 1, F.lit(0))
        ahead = F.when(n > 0, _spaces(F.col(f"p_{label}")[0]) - 1)
        behind = F.when(n > 0, _spaces(F.col("joined")) - 1 - (_spaces(F.element_at(f"p_{label}", -1)) - 1) - len(phrase.split(" ")))
        parts.append((label, n, ahead, behind))
    counted = counted.select(
        "row", "doc_id", "n_words", "joined",
        sum((n for _, n, _, _ in parts[1:]), parts[0][1]).cast("long").alias("n_base"),
        F.least(*[a for _, _, a, _ in parts]).alias("first_word"),
        F.greatest(*[b for _, _, _, b in parts]).alias("last_word"),
        F.array_compact(F.array(*[F.when(n > 0, F.lit(label)) for label, n, _, _ in parts])).alias("base_set"),
    )

    # only rules of whose keywords the text holds one are tried on it
    table = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(p).alias("priority"), F.lit(label).alias("label"), F.split(F.lit(k), r"\|").alias("keywords"), F.lit(e).alias("expression")) for n, p, label, k, e in rules()])
    tried = counted.where("joined IS NOT NULL").select("row", "joined", F.explode(F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("joined"), k)))).alias("r"))
    tried = tried.where(F.regexp_instr(F.col("joined"), F.col("r.expression")) > 0)
    found = tried.select("row", "r.*", F.call_function("split", "joined", "r.expression", F.lit(-1)).alias("between"), F.regexp_extract_all("joined", F.col("r.expression"), F.lit(0)).alias("matches"))
    # a match starts behind all pieces and matches before it; a running sum yields the starts
    lengths = F.transform(F.arrays_zip(F.slice("between", 1, F.size("matches")).alias("b"), F.col("matches").alias("m")), lambda z: F.struct(F.length(z["b"]).alias("b"), F.length(z["m"]).alias("m")))
    one = found.select("row", "rule", "priority", "label", F.posexplode(lengths).alias("nth", "l"))
    of_rule = Window.partitionBy("row", "rule").orderBy("nth")
    stop = F.sum(F.col("l.b") + F.col("l.m")).over(of_rule)
    spans = one.select("row", "rule", "priority", "label", (stop - F.col("l.m")).alias("start"), stop.alias("stop"))

    # swept by start: whatever stands before begins no later, so it contains this one if it ends no earlier
    before = Window.partitionBy("row").orderBy("start", F.desc("stop"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = spans
    for p in range(len(CONFIDENCE)):
        reach = reach.withColumn(f"r{p}", F.max(F.when(F.col("priority") <= p, F.col("stop"))).over(before))
    furthest = F.element_at(F.array(*[F.col(f"r{p}") for p in range(len(CONFIDENCE))]), F.col("priority") + 1)
    # of equal starts the longer stands first, so a stronger but shorter one can only follow; the strongest exact tie leads
    kept = reach.where(furthest.isNull() | (furthest < F.col("stop")))
    confidence = F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("priority") + 1)
    by_row = kept.groupBy("row").agg(F.collect_set("label").alias("method_set"), F.max(confidence).alias("score"), F.sort_array(F.collect_list(F.struct("start", "stop", "priority", "rule", "label"))).alias("detections"))
    out = counted.drop("joined").join(by_row, "row", "left")
    named = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    everything = F.concat("base_set", F.coalesce("method_set", F.array().cast("array<string>")))
    base_score = F.when(F.col("n_base") > 0, F.lit(CONFIDENCE[-1])).otherwise(F.lit(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", named(F.coalesce("base_set", F.array().cast("array<string>"))).alias("base_labels"), named(F.coalesce(everything, F.array().cast("array<string>"))).alias("labels"), F.greatest(F.coalesce("score", F.lit(0.0)), base_score).alias("score"), "detections")


def op6_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")


QUERIES = {"op6_license_rules": op6_license_rules}
ORACLES: dict[str, str] = {}
