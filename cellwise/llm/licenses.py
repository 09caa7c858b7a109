"""Operator 4: licence scans with ordered signature rules, in DataFrame functions only.

A text is normalised to its words, each between single spaces (`` w1  w2 ``). Rules are regular
expressions over words, gated by a keyword: the longest plain text that their matches must contain. A detection inside a longer
one, or equal to one of a rule that comes first, is suppressed; detections that overlap in part stay.
The rules are written one by one: texts of grants, notices, conditions and disclaimers, then names.

Null and empty texts have no words: zero counts, null first and last word, empty label strings and a
score of 0. Very long texts are searched whole. Of detections over the same words the first rule's stays.
Rows that repeat a doc_id each get a row. Other columns are left out, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only

#: Fixed values of the contract: phrase -> label.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label -> regexes of names; words are separated by one space here.
NAMES: dict[str, list[str]] = {
    "gpl": ["gnu general public licen[cs]e", "gnu general public licen[cs]e (?:version|v) ?[123](?: 0)?(?: or (?:any )?later(?: version)?)?"],
    "gpl-2.0": ["gpl 2 0(?: only| or later)?", "gplv2", "gnu gpl (?:version|v) ?2"],
    "gpl-3.0": ["gpl 3 0(?: only| or later)?", "gplv3", "gnu gpl (?:version|v) ?3"],
    "lgpl": ["gnu (?:lesser|library) general public licen[cs]e", "lgpl 2 1(?: only| or later)?", "lgpl 3 0(?: only| or later)?", "lgplv[23]"],
    "agpl": ["gnu affero general public licen[cs]e", "agpl 3 0(?: only| or later)?", "agplv3"],
    "gfdl": ["gnu free documentation licen[cs]e", "gfdl 1 [123]"],
    "apache": ["apache licen[cs]e", "apache software licen[cs]e", "apache (?:licen[cs]e )?(?:version )?1 1"],
    "apache-2.0": ["apache 2 0", "apache licen[cs]e (?:version )?2 0", "asl 2 0"],
    "mit": ["(?:the )?mit licen[cs]e", "mit x11 licen[cs]e", "mit no attribution", "expat licen[cs]e"],
    "bsd": ["(?:the )?bsd licen[cs]e", "berkeley software distribution", "bsd style licen[cs]e"],
    "bsd-2-clause": ["bsd 2 clause(?: licen[cs]e)?", "simplified bsd licen[cs]e", "freebsd licen[cs]e"],
    "bsd-3-clause": ["bsd 3 clause(?: licen[cs]e)?", "(?:new|revised|modified) bsd licen[cs]e"],
    "isc": ["isc licen[cs]e", "internet systems consortium licen[cs]e"],
    "mpl": ["mozilla public licen[cs]e(?: (?:version )?[12] [01])?", "mpl [12] [01]"],
    "epl": ["eclipse public licen[cs]e(?: (?:version |v )?[12] 0)?", "epl [12] 0"],
    "cddl": ["common development and distribution licen[cs]e", "cddl 1 [01]"],
    "eupl": ["european union public licen[cs]e", "eupl 1 [012]"],
    "artistic": ["artistic licen[cs]e(?: [12] 0)?"],
    "bsl": ["boost software licen[cs]e(?: (?:version )?1 0)?"],
    "busl": ["business source licen[cs]e(?: 1 1)?"],
    "zlib": ["zlib licen[cs]e", "zlib libpng licen[cs]e"],
    "unlicense": ["(?:the )?unlicen[cs]e"],
    "wtfpl": ["wtfpl(?: version 2)?"],
    "cc0": ["cc0(?: 1 0)?(?: universal)?"],
    "cc-by": ["cc by", "cc by [1234] [05]", "creative commons attribution(?: [1234] [05])?"],
    "cc-by-sa": ["cc by sa(?: [1234] [05])?", "creative commons attribution share ?alike(?: [1234] [05])?"],
    "cc-by-nc": ["cc by nc(?: [1234] [05])?", "creative commons attribution non ?commercial(?: [1234] [05])?"],
    "cc-by-nd": ["cc by nd(?: [1234] [05])?", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?"],
    "cc-by-nc-sa": ["cc by nc sa(?: [1234] [05])?"],
    "cc-by-nc-nd": ["cc by nc nd(?: [1234] [05])?"],
    "odbl": ["open (?:data commons open )?database licen[cs]e", "odbl(?: 1 0)?"],
    "ofl": ["sil open font licen[cs]e(?: (?:version )?1 1)?", "ofl 1 1"],
    "psf": ["python software foundation licen[cs]e(?: version 2)?", "psf 2 0"],
    "ruby": ["ruby licen[cs]e"],
    "openssl": ["openssl licen[cs]e", "original ssleay licen[cs]e"],
    "postgresql": ["postgresql licen[cs]e"],
    "x11": ["x11 licen[cs]e"],
    "cecill": ["cecill(?: [12] [01])?", "cecill [bc]"],
    "sspl": ["server side public licen[cs]e", "sspl 1 0"],
    "elastic": ["elastic licen[cs]e(?: 2 0)?"],
    "ms-pl": ["microsoft public licen[cs]e", "microsoft reciprocal licen[cs]e"],
}

#: Grants, notices, conditions and disclaimers: label -> regexes. Each is a signature of its own.
NOTICES: dict[str, list[str]] = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy", "to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies", "(?:released|licensed|distributed|available) under the (?:terms of the )?mit licen[cs]e",
        "use copy modify merge publish distribute sublicense and or sell copies",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and distribute this software for any purpose"],
    "x11": ["except as contained in this notice the name of the x consortium shall not be used"],
    "bsd": ["redistribution and use in source and binary forms", "this software is provided by the (?:regents|copyright holders) and contributors", "redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice"],
    "bsd-3-clause": ["neither the name of .{1,80} nor the names of its contributors", "may be used to endorse or promote products derived from this software"],
    "bsd-4-clause": ["all advertising materials mentioning features or use of this software", "this product includes software developed by"],
    "apache": ["licensed to the apache software foundation asf", "apache software foundation licenses this file", "this product includes software developed (?:at|by) the apache software foundation"],
    "apache-2.0": [
        "licensed under the apache licen[cs]e version 2 0", "you may not use this file except in compliance with the licen[cs]e", "you may obtain a copy of the licen[cs]e at",
        "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e", "see the licen[cs]e for the specific language governing permissions", "http www apache org licen[cs]es licen[cs]e 2 0",
        "grant of patent licen[cs]e subject to the terms and conditions of this licen[cs]e",
    ],
    "gpl": [
        "this program is free software you can redistribute it and or modify", "published by the free software foundation", "you should have received a copy of the gnu general public licen[cs]e",
        "see the gnu general public licen[cs]e for more details", "either version [123] of the licen[cs]e or at your option any later version", "51 franklin street", "59 temple place suite 330", "675 mass ave cambridge", "gnu org licen[cs]es gpl",
        "released under the (?:terms of the )?gnu gpl", "licensed under the (?:terms of the )?gpl",
    ],
    "gpl-2.0": ["gnu general public licen[cs]e version 2 as published", "version 2 june 1991", "licensed under gplv2"],
    "gpl-3.0": ["version 3 29 june 2007", "either version 3 of the licen[cs]e", "licensed under gplv3"],
    "lgpl": ["this library is free software you can redistribute it", "see the gnu lesser general public licen[cs]e for more details", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", "version 2 1 february 1999", "gnu org licen[cs]es lgpl"],
    "agpl": ["see the gnu affero general public licen[cs]e for more details", "you should have received a copy of the gnu affero general public licen[cs]e", "version 3 19 november 2007", "gnu org licen[cs]es agpl"],
    "gfdl": ["permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation", "with no invariant sections no front cover texts"],
    "gpl-exception": ["as a special exception the copyright holders", "classpath exception", "gcc runtime library exception", "font exception", "linking exception"],
    "mpl": ["this source code form is subject to the terms of the mozilla public licen[cs]e", "if a copy of the mpl was not distributed with this file", "the contents of this file are subject to the mozilla public licen[cs]e", "mozilla org mpl", "incompatible with secondary licen[cs]es"],
    "epl": ["this program and the accompanying materials are made available under the terms of the eclipse public", "eclipse org legal epl", "eclipse distribution licen[cs]e"],
    "cddl": ["the contents of this file are subject to the terms of the common development and distribution", "cddl header start", "you can obtain a copy of the licen[cs]e at usr src opensolaris"],
    "eupl": ["licensed under the eupl", "joinup ec europa eu"],
    "cpl": ["common public licen[cs]e(?: (?:version )?1 0)?", "ibm public licen[cs]e"],
    "artistic": ["the intent of this document is to state the conditions under which a package may be copied", "same terms as perl(?: itself)?"],
    "bsl": ["boost org licen[cs]e 1 0", "permission is hereby granted free of charge to any person or organization obtaining a copy"],
    "zlib": ["this software is provided as is without any express or implied warranty", "the origin of this software must not be misrepresented", "altered source versions must be plainly marked as such", "this notice may not be removed or altered from any source distribution"],
    "libpng": ["libpng licen[cs]e", "this copy of the libpng notices"],
    "ijg": ["independent jpeg group s software", "this software is based in part on the work of the independent jpeg group"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software"],
    "wtfpl": ["do what the fuck you want to", "do what you want to public licen[cs]e"],
    "beerware": ["beer ?ware licen[cs]e", "you can buy me a beer in return"],
    "jquery": ["jquery org licen[cs]e"],
    "json": ["the software shall be used for good not evil"],
    "curl": ["curl licen[cs]e", "curl and libcurl are licensed"],
    "icu": ["icu licen[cs]e", "unicode licen[cs]e(?: agreement)?", "unicode inc licen[cs]e agreement"],
    "ncsa": ["university of illinois ncsa open source licen[cs]e", "llvm release licen[cs]e"],
    "w3c": ["w3c software (?:notice and )?licen[cs]e", "w3c document licen[cs]e"],
    "php": ["php licen[cs]e(?: version)? 3 0[01]?", "this product includes php software"],
    "zend": ["zend engine licen[cs]e"],
    "qpl": ["q public licen[cs]e"],
    "sleepycat": ["sleepycat licen[cs]e", "redistributions in any form must be accompanied by information on how to obtain complete source code"],
    "afl": ["academic free licen[cs]e(?: (?:version )?[123] [012])?"],
    "osl": ["open software licen[cs]e(?: (?:version )?[123] [01])?"],
    "upl": ["universal permissive licen[cs]e"],
    "bittorrent": ["bittorrent open source licen[cs]e"],
    "vim": ["vim licen[cs]e"],
    "tcl": ["tcl tk licen[cs]e", "the authors hereby grant permission to use copy modify distribute"],
    "ftl": ["freetype project licen[cs]e", "freetype licen[cs]e"],
    "openldap": ["openldap public licen[cs]e"],
    "cc0": ["creativecommons org publicdomain zero", "to the extent possible under law .{1,80} waived all copyright", "waived all copyright and related or neighboring rights", "creative commons zero"],
    "cc-by": ["creativecommons org licen[cs]es by [1234] [05]", "licensed under a creative commons attribution", "this work is licensed under the creative commons attribution [1234] [05]"],
    "cc-by-sa": ["creativecommons org licen[cs]es by sa", "creative commons by sa", "attribution share ?alike [1234] [05]"],
    "cc-by-nc": ["creativecommons org licen[cs]es by nc [1234]", "attribution non ?commercial [1234] [05]"],
    "cc-by-nd": ["creativecommons org licen[cs]es by nd", "attribution no ?derivatives [1234] [05]"],
    "cc-by-nc-sa": ["creativecommons org licen[cs]es by nc sa", "attribution non ?commercial share ?alike"],
    "cc-by-nc-nd": ["creativecommons org licen[cs]es by nc nd", "attribution non ?commercial no ?deriv"],
    "odc-by": ["open data commons attribution licen[cs]e", "odc by 1 0"],
    "pddl": ["public domain dedication and licen[cs]e", "opendatacommons org licen[cs]es pddl"],
    "odbl": ["opendatacommons org licen[cs]es odbl", "made available under the open database licen[cs]e"],
    "ogl": ["open government licen[cs]e(?: v[123] 0)?", "contains public sector information licensed under"],
    "ofl": ["this font software is licensed under the sil open font", "scripts sil org ofl", "reserved font name"],
    "public-domain": ["(?:released|placed|dedicated) (?:in|into|to) the public domain", "this (?:work|file|software) is in the public domain", "work of the u s government", "public domain mark", "public domain"],
    "sspl": ["mongodb com licensing server side public"],
    "elastic": ["elastic co licensing elastic licen[cs]e"],
    "commons-clause": ["commons clause(?: licen[cs]e condition)?", "does not grant to you the right to sell the software"],
    "polyform": ["polyform (?:noncommercial|shield|strict|small business|perimeter) licen[cs]e"],
    "prosperity": ["prosperity public licen[cs]e"],
    "openrail": ["open ?rail m? ?licen[cs]e", "use based restrictions as referenced in paragraph 5"],
    "llama": ["llama [23] community licen[cs]e(?: agreement)?"],
    "ms-pl": ["ms pl licen[cs]e", "ms rl licen[cs]e"],
    "ms-eula": ["microsoft software licen[cs]e terms", "end user licen[cs]e agreement"],
    "oracle": ["oracle technology network licen[cs]e", "oracle binary code licen[cs]e", "netbeans licen[cs]e"],
    "apple": ["apple public source licen[cs]e", "apple sample code licen[cs]e"],
    "intel": ["intel simplified software licen[cs]e", "intel open source licen[cs]e"],
    "nvidia": ["nvidia source code licen[cs]e", "nvidia software licen[cs]e"],
    "proprietary": ["unauthorized (?:copying|use|reproduction|distribution) of this", "proprietary and confidential", "confidential and proprietary", "no part of this (?:publication|document|work|book) may be reproduced", "this material may not be published broadcast rewritten or redistributed", "for internal use only", "all rights reserved"],
    "no-warranty": [
        "without (?:any )?warrant(?:y|ies)(?: of any kind| or conditions of any kind)?", "the software is provided as is", "on an as is basis", "as is basis", "implied warranty of merchantability or fitness", "merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the (?:authors|copyright holders?|contributors)", "disclaims? all warranties", "limitation of liability",
    ],
    "copyright": ["copyright(?: c)?(?: by)?(?: (?:19|20)[0-9][0-9])+", "spdx filecopyrighttext", "portions copyright"],
    "other": ["licen[cs]eref [a-z]+"],
    "dual": ["dual licensed under", "you may choose (?:either|one of the following) licen[cs]es?", "alternatively this (?:file|software) may be (?:used|distributed) under the terms"],
}

#: Words of which every signature has one, in its plain text, or else the text as a whole stands for it.
TRIGGERS = ["licen", "warrant", "permission", "redistribut", "copyright", "public domain", "creativecommons", "attribution", "this software", "of this", "foundation"]
#: How sure a signature is of its label: names alone, long texts, and those that say little by themselves.
CONFIDENCE, WEAK = {"name": 0.6, "text": 0.95}, {"copyright": 0.4, "no-warranty": 0.4, "proprietary": 0.5, "other": 0.6, "dual": 0.6, "public-domain": 0.7}


def rules() -> list[tuple[int, str, str, str, float]]:
    """All rules in order: (priority, keyword, regex, label, confidence). Notices come before names."""
    found = [(literal(r), r, label, WEAK.get(label, CONFIDENCE["text"])) for label, own in NOTICES.items() for r in own]
    found += [(literal(r), r, label, CONFIDENCE["name"]) for label, own in NAMES.items() for r in own]
    # A space of a rule is the two spaces between words of the normalised text; a match takes one on
    # either side, and beginning with a plain character keeps the search quick.
    spaced = [(k, f" (?:{r.replace(' ?', '(?:  )?').replace(' ', '  ').replace('(?:    )?', '(?:  )?')}) ", lab, c) for k, r, lab, c in found]
    return [(n, k[:1] + k[1:].replace(" ", "  "), r, lab, c) for n, (k, r, lab, c) in enumerate(spaced)]


def _spaces(of: Column) -> Column:
    return F.length(of) - F.length(F.replace(of, F.lit(" "), F.lit("")))


def literal(regex: str) -> str:
    """The longest run of plain characters that every match of ``regex`` contains."""
    while re.search(r"\(\?:[^()]*\)\??", regex):
        regex = re.sub(r"\(\?:[^()]*\)\??", "|", regex)
    regex = re.sub(r".\?|\[[^]]*\]", "|", regex)
    runs = re.split(r"[^a-z0-9 ]", regex)
    best = max(runs, key=lambda r: len(r.strip()))
    return (" " if best == runs[0] else "") + best.strip()


def scan(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs``, and the number of detections kept."""
    text = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.trim(F.regexp_replace(text, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", "  "))
    rows = only(docs, doc_id="long", text="string").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("bare")
    )
    rows = rows.select("row", "doc_id", F.when(F.col("bare") == "", "").otherwise(F.concat(F.lit(" "), "bare", F.lit(" "))).alias("norm"))
    rows = rows.withColumn("n_words", (_spaces(F.col("norm")) / 2).cast("long"))
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        p = f" {phrase.replace(' ', '  ')} "
        has = F.contains("norm", F.lit(p))
        places.append(F.when(has, (F.length("norm") - F.length(F.replace("norm", F.lit(p), F.lit("")))) / len(p)).otherwise(0).cast("long"))
        firsts.append(F.when(has, _spaces(F.substring_index("norm", p, 1)) / 2).cast("long"))
        lasts.append(F.when(has, F.col("n_words") - _spaces(F.substring_index("norm", p, -1)) / 2 - len(phrase.split())).cast("long"))
        labels.append(F.when(has, F.lit(label)))
    keywords: dict[str, list] = {}
    for rule in rules():
        keywords.setdefault(rule[1], []).append(rule)
    as_rule = lambda r: F.struct(F.lit(r[0]).alias("priority"), F.lit(r[2]).alias("regex"), F.lit(r[3]).alias("label"), F.lit(r[4]).alias("confidence"))
    groups = F.array(*[F.struct(F.lit(k).alias("keyword"), F.array(*map(as_rule, own)).alias("rules")) for k, own in keywords.items()])
    plain = {next((t for t in (x.replace(" ", "  ") for x in TRIGGERS) if t in k), k.strip()) for k in keywords}
    stems = sorted(k for k in plain if not any(other in k for other in plain - {k}))
    gated = F.when(
        reduce(or_, [F.contains("norm", F.lit(k)) for k in stems]),
        F.flatten(F.transform(F.filter(groups, lambda g: F.contains("norm", g["keyword"])), lambda g: F.filter(g["rules"], lambda r: F.regexp_like("norm", r["regex"])))),
    )
    rows = rows.select(
        "row", "doc_id", "n_words", "norm",
        sum(places[1:], places[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
        F.explode_outer(gated).alias("rule"),
    )
    kept = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "rule"]
    marked = F.when(F.col("rule").isNotNull(), F.split(F.regexp_replace("norm", F.col("rule.regex"), F.lit("\x01$0\x02")), "\x01"))
    parts = rows.select(*kept, F.posexplode_outer(marked).alias("at", "part"))
    # From here on rows carry counts instead of text; only they are dealt out.
    parts = parts.select(
        "row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "at",
        F.col("rule.priority").alias("priority"), F.col("rule.label").alias("label"), F.col("rule.confidence").alias("confidence"),
        _spaces(F.col("part")).alias("spaces"),
        (_spaces(F.substring_index("part", "\x02", 1)) / 2).cast("long").alias("length"),
    )
    before = Window.partitionBy("row", "priority").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    spans = parts.withColumn("start", F.floor(F.sum("spaces").over(before) / 2)).withColumn("end", F.col("start") + F.col("length"))
    spans = spans.withColumn("end", F.when(F.col("at") > 0, F.col("end")))
    # A span is contained in another exactly if one that sorts before it ends no earlier.
    order = Window.partitionBy("row").orderBy(F.col("start").asc_nulls_last(), F.col("end").desc_nulls_last(), "priority").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reach", F.max("end").over(order))
    stays = F.col("end").isNotNull() & (F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    return (
        spans.groupBy("row")
        .agg(
            *[F.first(c).alias(c) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base")],
            F.collect_set(F.when(stays, F.col("label"))).alias("more"),
            F.max(F.when(stays, F.col("confidence"))).alias("best"),
            F.count_if(stays).alias("n_detections"),
        )
        .select(
            "doc_id", "n_words", "n_base", "first_word", "last_word",
            F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_distinct(F.concat("base", "more"))), ",").alias("labels"),
            F.coalesce(F.greatest("best", F.when(F.col("n_base") > 0, 0.6)), F.lit(0.0)).alias("score"),
            "n_detections",
        )
    )
