"""Licence scan by TF-IDF cosine to templates and inheritance along paths (operator 1), in DataFrame functions alone.

Two kinds of units are weighed. Notices: lines that speak of licences, anywhere in a text, the whole of a file whose name says that
it is a licence, and what is cut out of lines and of blocks (such lines with the two after each, joined where they touch): runs
of words that notices use, between sentence ends, or with up to ``GAP`` other words left out between two of them. The document frequencies of all
their words come from all notice units of the table and ``TEMPLATES``; each takes the template of largest cosine, if it reaches the threshold, which is higher for cuts.
Whole texts: of files named so, of those whose licence lines make up ``TEXT_SHARE`` of them or that have ``TEXT_START``, without their copyright lines. They are
held against whole licences (``licence_texts``), with frequencies of those alone, so that no cosine depends on the size of the table.
A file's own licence is that of its whole text, else that of its best notice; a reservation of rights counts where nothing is granted.
A file whose name says so, or that hardly holds anything but a licence, is its directory's licence; a directory with
several takes the commonest. A file without a licence of its own inherits that of its nearest ancestor directory.

Only units are exploded into words, and whole texts only of the files above. Directories are resolved once each, by a join of their
ancestors' paths, so that a directory with very many files costs one row there.

Defined results: a null or empty text has no licence of its own; a null path has no directory and inherits nothing.
Ties go to the earlier unit and to the licence first in alphabetical order. Repeated rows are scanned alike.
"""

from __future__ import annotations

import re
from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, written

#: Words that a broadcast may hold, of about 40 bytes each. More are joined by an exchange.
BROADCAST_WORDS = 500_000

#: Short notices by licence: what headers and licence files say of themselves.
TEMPLATES = {
    "MIT": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", "spdx-license-identifier mit", "licensed under the mit license"],
    "Apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "spdx-license-identifier apache-2.0"],
    "GPL-3.0": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license either version 3 of the license or any later version", "spdx-license-identifier gpl-3.0"],
    "GPL-2.0": ["licensed under the gnu general public license version 2", "redistribute it and or modify it under the terms of the gnu general public license version 2 of the license", "spdx-license-identifier gpl-2.0"],
    "LGPL-3.0": ["licensed under the gnu lesser general public license version 3", "spdx-license-identifier lgpl-3.0"],
    "AGPL-3.0": ["licensed under the gnu affero general public license version 3", "spdx-license-identifier agpl-3.0"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license version 2.0", "spdx-license-identifier mpl-2.0"],
    "BSD-3-Clause": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met neither the name", "licensed under the 3-clause bsd license", "licensed under the bsd 3-clause license", "spdx-license-identifier bsd-3-clause"],
    "BSD-2-Clause": ["licensed under the 2-clause bsd license", "licensed under the bsd 2-clause license", "spdx-license-identifier bsd-2-clause"],
    "CC-BY-4.0": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-SA-4.0": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "CC-BY-NC-4.0": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "CC0-1.0": ["released under cc0 1.0 universal public domain dedication", "dedicated to the public domain under cc0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "Proprietary": ["all rights reserved", "copyright all rights reserved", "proprietary and confidential unauthorized copying of this file is strictly prohibited"],
}
CUE = r"(?i)licen[cs]|copyright|spdx|permission is|redistribut|public domain|unencumbered|rights reserved|proprietary|compliance with"
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*+"
MIN_COSINE = 0.6
#: A text whose licence lines hold this share of its characters is a licence file whatever its name.
FILE_SHARE = 0.5
#: What is cut out of lines and blocks has no other words to lower its cosine, so it must be nearer.
CUT_COSINE, GAP = 0.8, 3
#: Texts are compared whole from this share of characters in licence lines on; those in ``licence_texts`` have 0.16 and more.
#: MIT files with other holders (123 from crates) lay at 0.92 and above.
TEXT_SHARE, TEXT_COSINE = 0.1, 0.9
#: 0BSD has hardly a line that a cue finds, so texts that begin like it are compared as well.
TEXT_START = r"(?is)^.{0,500}permission to use,\W+copy"
COPYRIGHT_LINE = r"(?im)^[^\w\n]*copyright\b[^\n]{0,100}\d{4}[^\n]{0,100}$"
#: AGPL-3.0 is GPL-3.0 under another name and with this in section 13. Made here, as its file was not at hand.
AFFERO = "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the corresponding source of your version by providing access to the corresponding source from a network server at no charge "


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def _texts() -> dict[str, str]:
    """Whole licences by name."""
    folder = resources(__package__) / "licence_texts"
    found = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
    found["AGPL-3.0"] = re.sub(r"(?i)gnu general public", "GNU Affero General Public", found["GPL-3.0"]) + AFFERO
    return {name: " ".join(re.findall(WORD, re.sub(COPYRIGHT_LINE, "", text).lower())) for name, text in sorted(found.items())}


def _cuts(lines: Column, cues: Column) -> Column:
    """Notices cut out of the lines with cues and the two after each, as strings of words."""
    vocabulary = sorted({w for notices in TEMPLATES.values() for notice in notices for w in notice.split()})
    near = lambda i: F.coalesce(F.get(cues, i), F.lit(False)) | F.coalesce(F.get(cues, i - 1), F.lit(False)) | F.coalesce(F.get(cues, i - 2), F.lit(False))
    joined = F.array_join(F.transform(lines, lambda x, i: F.when(near(i), F.replace(F.lower(x), F.lit("|"), F.lit(" "))).otherwise("|")), "\n")
    blocks = F.filter(F.split(joined, r"\n*\|[|\n]*"), lambda b: b.rlike(CUE))
    # Other words become bars and sentence ends slashes, which no word holds.
    marked = F.transform(blocks, lambda b: F.array_join(F.transform(F.regexp_extract_all(F.regexp_replace(b, r"/|[.;:!?](?=\s|$)", " / ").alias("b"), F.lit(f"({WORD}|(?<= )/(?= ))"), F.lit(1)), lambda w: F.when(F.array_contains(F.array(*map(F.lit, [*vocabulary, "/"])), w), w).otherwise("|")), " "))
    runs = F.flatten(F.transform(marked, lambda m: F.concat(F.split(m, r" *[|/][ |/]*"), F.split(F.regexp_replace(m, "/ ?", ""), r" *\|(?: \|){%d}[ |]*" % GAP))))
    return F.filter(F.transform(runs, lambda r: F.btrim(F.regexp_replace(r, r"[ |]+", " "))), lambda r: r.rlike(CUE))


def _whole(base: DataFrame) -> DataFrame:
    """``row``, ``text_licence`` and ``text_cosine`` of the whole texts near a whole licence."""
    spark = base.sparkSession
    texts = _texts()
    table = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts.values())) + " AS t(licence, words)")
    tf = table.select("licence", F.explode(F.split("words", " ")).alias("word")).groupBy("licence", "word").agg(F.count("*").alias("tf"))
    idf = tf.groupBy("word").agg((F.log(F.lit(len(texts) + 1.0)) - F.log(F.count("*") + 1.0) + 1.0).alias("idf"))
    weighed = tf.join(F.broadcast(idf), "word").withColumn("tw", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("licence").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    # One row for each word of the licences, with its share in each of them.
    sides = weighed.join(F.broadcast(norms), "licence").groupBy("word").agg(F.first("idf").alias("idf"), *[F.sum(F.when(F.col("licence") == i, F.col("tw") / F.col("tn")).otherwise(0.0)).alias(f"s{i}") for i in range(len(texts))])
    rare = F.log(F.lit(len(texts) + 1.0)) - F.log(F.lit(2.0)) + 1.0
    words = base.where("full IS NOT NULL").select("row", F.explode(_words(F.regexp_replace("full", COPYRIGHT_LINE, ""))).alias("word"))
    words = words.groupBy("row", "word").agg(F.count("*").alias("tf")).join(F.broadcast(sides), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", rare))
    dots = words.groupBy("row").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("un"), *[F.coalesce(F.sum(F.col("w") * F.col(f"s{i}")), F.lit(0.0)).alias(f"d{i}") for i in range(len(texts))])
    near = F.array_min(F.array(*[F.struct((-F.round(F.col(f"d{i}") / F.col("un"), 9)).alias("c"), F.lit(name).alias("licence")) for i, name in enumerate(texts)]))
    return dots.select("row", near.alias("b")).select("row", F.col("b.licence").alias("text_licence"), (-F.col("b.c")).alias("text_cosine")).where(F.col("text_cosine") >= TEXT_COSINE)


def scan(files: DataFrame, path: Column | str, key: str = "doc_id", text: str = "text", min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row per file: ``path``, ``own_licence`` with its ``cosine``, ``licence`` (own or inherited) and ``inherited_from``."""
    spark = files.sparkSession
    path = F.col(path) if isinstance(path, str) else path
    # Rows are told apart by a number of their own, so that repeated keys and paths don't mix.
    base = spread(files.select(F.col(key).alias("key"), path.alias("path"), F.coalesce(F.col(text), F.lit("")).alias("t")))
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME), F.lit(False))
    base = base.select("key", "path", "t", named.alias("named"), F.split("t", "\n").alias("lines"), F.length(F.btrim("t", F.lit(" \t\n\r"))).alias("size"))
    base = base.select("*", F.when(F.col("t").rlike(CUE), F.transform("lines", lambda x: x.rlike(CUE))).alias("cues"))
    cued = F.when(F.col("cues").isNull(), F.array().cast("array<string>")).otherwise(F.filter("lines", lambda x, i: F.get("cues", i)))
    base = base.select("*", cued.alias("cued"))
    base = base.select("*", F.aggregate("cued", F.lit(0), lambda a, x: a + F.length(x)).alias("cued_size"))
    units = F.when(F.col("named"), F.array("t")).otherwise(F.array().cast("array<string>"))
    base = base.select("*", F.transform(F.concat(units, F.when(F.col("named") & (F.size("lines") == 1), F.array().cast("array<string>")).otherwise(F.col("cued"))), lambda x: F.array_join(_words(x), " ")).alias("uncut"))
    cuts = F.when(F.size("cued") > 0, _cuts(F.col("lines"), F.col("cues"))).otherwise(F.array().cast("array<string>"))
    base = base.select("*", F.concat("uncut", F.array_except(cuts, F.col("uncut"))).alias("units"), F.size("uncut").alias("n_uncut"), F.when(F.col("named") | F.col("t").rlike(TEXT_START) | (F.size("cued") > 0) & (F.col("cued_size") >= TEXT_SHARE * F.col("size")), F.col("t")).alias("full"))
    base = base.select(F.monotonically_increasing_id().alias("row"), "key", "path", "named", "units", "n_uncut", "full", "size", (~F.col("named") & (F.col("cued_size") >= FILE_SHARE * F.col("size")) & (F.size("cued") > 0)).alias("whole"))
    base = written(base)  # with their numbers, which would differ in another run
    units = base.where(F.size("units") > 0).select("row", "n_uncut", F.posexplode("units").alias("unit", "line"))
    tf = units.select("row", "unit", (F.col("unit") >= F.col("n_uncut")).alias("cut"), F.explode(_words(F.col("line"))).alias("word")).groupBy("row", "unit", "cut", "word").agg(F.count("*").alias("tf"))
    tf = written(tf)
    rows = [(name, i, w) for name, notices in TEMPLATES.items() for i, notice in enumerate(notices) for w in notice.split()]
    template_tf = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{a}', {i}, '{w}')" for a, i, w in rows) + " AS t(licence, notice, word)").groupBy("licence", "notice", "word").agg(F.count("*").alias("tf"))
    # Document frequencies of all words. Those of templates are bounded by TEMPLATES; of the others, those that one unit has need no row.
    vocabulary = template_tf.groupBy("word").agg(F.count("*").alias("in_templates"))
    seen = tf.groupBy("word").agg(F.count("*").alias("in_units")).join(F.broadcast(vocabulary.select("word", F.lit(True).alias("known"))), "word", "left")
    seen = written(seen.where("in_units > 1 OR known"))
    others = seen.where("known IS NULL").select("word", F.col("in_units").alias("met"))
    others = F.broadcast(others) if others.count() <= BROADCAST_WORDS else others
    n = tf.select("row", "unit").distinct().count() + sum(map(len, TEMPLATES.values()))
    rare = F.log(F.lit(n) + 1.0) - F.log(F.lit(2.0)) + 1.0
    idf = vocabulary.join(F.broadcast(seen.where("known").select("word", "in_units")), "word", "left").select("word", (F.log(F.lit(n) + 1.0) - F.log(F.col("in_templates") + F.coalesce("in_units", F.lit(0)) + 1.0) + 1.0).alias("idf"))
    # Both tables have no more rows than TEMPLATES has words.
    weighed = template_tf.join(F.broadcast(idf), "word").withColumn("tw", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("licence", "notice").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    sides = weighed.join(F.broadcast(norms), ["licence", "notice"]).groupBy("word").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("licence", "notice", (F.col("tw") / F.col("tn")).alias("tw"))).alias("sides"))
    unit_words = tf.join(F.broadcast(sides), "word", "left").join(others, "word", "left")
    unit_words = unit_words.withColumn("w", F.col("tf") * F.coalesce("idf", F.log(F.lit(n) + 1.0) - F.log(F.col("met") + 1.0) + 1.0, rare))
    length = unit_words.groupBy("row", "unit", "cut").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("un"))
    dots = unit_words.where("sides IS NOT NULL").select("row", "unit", "w", F.explode("sides").alias("s")).groupBy("row", "unit", "s.licence", "s.notice").agg(F.sum(F.col("w") * F.col("s.tw")).alias("dot"))
    scored = dots.join(length, ["row", "unit"]).withColumn("cosine", F.round(F.col("dot") / F.col("un"), 9)).where(F.col("cosine") >= F.when(F.col("cut"), max(min_cosine, CUT_COSINE)).otherwise(min_cosine))
    best = scored.groupBy("row").agg(F.min(F.struct((F.col("licence") == "Proprietary").alias("reserved"), (-F.col("cosine")).alias("c"), "unit", "licence", "cut")).alias("b")).select("row", F.col("b.licence").alias("notice_licence"), (-F.col("b.c")).alias("notice_cosine"), F.col("b.cut").alias("cut"), F.col("b.unit").alias("best_unit"))
    own = base.select("row", "key", "path", "named", "whole", "size", "units").join(best, "row", "left").join(written(_whole(base)), "row", "left")
    # A notice cut out of a long line makes a licence file only if it is that long itself.
    whole = F.col("whole") & (~F.coalesce("cut", F.lit(False)) | (F.length(F.get("units", "best_unit")) >= FILE_SHARE * F.col("size")))
    own = own.select("key", "path", "named", (whole | F.col("text_licence").isNotNull()).alias("whole"), F.coalesce("text_licence", "notice_licence").alias("own_licence"), F.coalesce("text_cosine", "notice_cosine").alias("cosine")).withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    stated = own.where("own_licence IS NOT NULL AND (named OR whole) AND dir IS NOT NULL").groupBy("dir", "own_licence").count()
    stated = stated.groupBy("dir").agg(F.min(F.struct((-F.col("count")).alias("c"), "own_licence")).alias("b")).select("dir", F.col("b.own_licence").alias("dir_licence"))
    dirs = own.where("dir IS NOT NULL").select("dir").distinct()
    # A directory, its parent, and so on up to the first; the empty directory stands for the root.
    parts = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))).alias("a")).select("dir", "a.*")
    near = ancestors.join(stated.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "dir_licence")).alias("b"))
    near = near.select("dir", F.col("b.dir_licence").alias("dir_licence"), F.col("b.above").alias("above"))
    out = own.join(near, "dir", "left")
    return out.select(F.col("key").alias(key), F.col("path"), "own_licence", "cosine", F.coalesce("own_licence", "dir_licence").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("above")).alias("inherited_from"), F.coalesce(F.col("own_licence").isNotNull() & (F.col("named") | F.col("whole")), F.lit(False)).alias("is_licence_file"))
