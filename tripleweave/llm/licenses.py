"""Licence texts found by known sentences and ordered rules.

A text is cut into pieces at line breaks, semicolons and the ends of sentences, each normalised to its words.
A known sentence is found as one piece or as several consecutive ones, as it is when it is wrapped over lines
or has semicolons inside; only a full stop, question or exclamation mark ends it. Empty pieces are passed
over. Sentences that a licence is known to consist of have identifiers; the sequence of identifiers a text
shows, in order, is matched against rules, each an ordered sequence of identifiers that together mean one
licence. Between two identifiers of a rule at most ``GAP`` other sentences may stand; lines of one sentence
count once, and the number of a list item counts with the item behind it. Everything is DataFrame functions; sentences are looked up in a table of
fixed size, so only known ones leave the row they are in.

Defined cases: a null or empty text has no sentences. A null id keeps its own row; repeated rows are judged
one by one. A licence found several times is listed once, with its first place and the number of places.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 3

# Normalised sentences of widely used public licences and notices, with identifiers.
SENTENCES = {
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "cc-by-nc-4": "licensed under cc by nc 4 0",
    "cc-by-4": "licensed under cc by 4 0",
    "cc-by-sa-4": "licensed under cc by sa 4 0",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
}

# Licences as ordered identifiers.
RULES = [
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0", ["gpl-redistribute", "gpl-hope", "gpl-details"]),
    ("GPL-2.0", ["gpl2-redistribute", "gpl-hope", "gpl-details"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-header", "apache-copy", "apache-basis"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant", "mit-keep", "as-is"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("BSD", ["bsd-conditions", "bsd-as-is"]),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A sentence ends at the end of a line, or at a full stop, question or exclamation mark or semicolon
# before white space.
END = r"(?:[.!?;]+[\x20\x09-\x0D]+|\n)"
# Of these ends, those that a known sentence cannot reach over; not the one behind a list number.
_RUN = r"(?<![.!?;])[.!?;]*[.!?][.!?;]*"
_NUMBER = r"(?<!(?:^|\n)[^0-9A-Za-z\n]{0,20}[0-9]{1,3})"
STOP = rf"(?:{_RUN}[\x20\x09]*[\r\n][\x20\x09-\x0D]*|{_NUMBER}{_RUN}[\x20\x09-\x0D]+)"


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^0-9a-z]+", " "))


def sentences(text: Column) -> Column:
    """The normalised pieces of a text: ASCII letters and digits in lower case, words a space apart.

    Pieces without such a word are empty but keep their place.
    """
    return F.transform(F.split(F.coalesce(text, F.lit("")), END, -1), _words)


HIT = "array<struct<place:int,sentence:string,last:int,of:int,begin:int,end:int>>"


def _joined(full: Column, names: Column, catalog: dict[str, str]) -> Column:
    """Hits of several pieces: from each piece that opens a known sentence on, joined one by one."""
    most = max(len(s.split()) for s in catalog.values())
    said = F.array(*map(F.lit, catalog.values()))

    def grow(x):
        def step(acc, y):
            text = F.when(y["of"] == x["of"], F.concat(acc["text"], F.lit(" "), y["said"]))
            hit = _hit(x, y, names[text])
            return F.struct(text.alias("text"), F.when(hit["sentence"].isNotNull(), F.concat(acc["hits"], F.array(hit).cast(HIT))).otherwise(acc["hits"]).alias("hits"))

        return step

    def from_here(x, i):
        opens = F.exists(said, lambda k: k.startswith(F.concat(x["said"], F.lit(" "))))
        start = F.struct(x["said"].alias("text"), F.array().cast(HIT).alias("hits"))
        grown = F.aggregate(F.slice(full, i + 2, F.lit(most)), start, grow(x), lambda acc: acc["hits"])
        return F.when(opens, grown).otherwise(F.array().cast(HIT))

    return F.flatten(F.transform(full, from_here))


def _hit(x: Column, y: Column, name: Column) -> Column:
    fields = (x["place"], "place"), (name, "sentence"), (y["place"], "last"), (x["of"], "of"), (x["j"], "begin"), (y["j"], "end")
    return F.struct(*(c.alias(n) for c, n in fields))


def _weight(group: Column, hits: Column, last: Column) -> Column:
    """What a sentence counts for the gap, and how many of its first pieces count nothing.

    Pieces around its hits are one sentence before and one after; without hits it is one altogether.
    """
    low, high = F.array_min(F.transform(hits, lambda h: h["begin"])), F.array_max(F.transform(hits, lambda h: h["end"]))
    some = lambda test: F.exists(group, lambda x: (x["said"] != "") & test(x["j"])).cast("int")
    lead, rest = some(lambda j: j < low), some(lambda j: j > high)
    own = F.when(F.size(hits) == 0, F.lit(1)).otherwise(high - low + 1 + lead + rest)
    # Text that no full stop ends is counted by its lines.
    skip = F.when(last | (F.size(hits) == 0), F.lit(0)).otherwise(low - lead)
    return F.struct(own.alias("size"), skip.alias("skip"))


def known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalog=SENTENCES) -> DataFrame:
    """``(doc_id, n_sentences, hits)``, the hits an array of (place, sentence, first, last) in order.

    ``place`` counts pieces. ``first`` and ``last`` count what stands before a hit's first and last piece for
    the gap: a sentence without hits is one, however many lines it has.
    """
    names = F.create_map(*(F.lit(x) for name, s in catalog.items() for x in (s, name)))
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    own = own.withColumn("__s", F.filter(sentences(F.col("__t")), lambda s: s != ""))
    own = own.withColumn("__flat", F.array_join("__s", " "))
    any_known = F.exists(F.array(*map(F.lit, catalog.values())), lambda k: F.contains(F.col("__flat"), k))
    piece = lambda g: lambda s, j: F.struct(_words(s).alias("said"), g.alias("of"), j.alias("j"))
    groups = F.transform(F.split("__t", STOP, -1), lambda h, g: F.transform(F.split(h, END, -1), piece(g)))
    own = own.withColumn("__g", F.when(any_known, groups))
    placed = F.transform(
        F.flatten("__g"), lambda x, i: F.struct(i.alias("place"), x["said"].alias("said"), x["of"].alias("of"), x["j"].alias("j"))
    )
    own = own.withColumn("__full", F.filter(placed, lambda x: x["said"] != ""))
    single = F.filter("__full", lambda x: x["said"].isin(list(catalog.values())))
    single = F.transform(single, lambda x: _hit(x, x, names[x["said"]])).cast(HIT)
    hits = F.array_sort(F.concat(single, _joined(F.col("__full"), names, catalog)))
    own = own.withColumn("__h", F.coalesce(hits, F.array().cast(HIT)))
    own = own.withColumn("__w", F.transform("__g", lambda g, i: _weight(g, F.filter("__h", lambda h: h["of"] == i), i == F.size("__g") - 1)))
    before = lambda h: F.aggregate(F.slice("__w", F.lit(1), h["of"]), F.lit(0), lambda a, w: a + w["size"])
    at = lambda h, j: before(h) + j - F.element_at("__w", h["of"] + 1)["skip"]
    told = lambda h: F.struct(
        h["place"].alias("place"), h["sentence"].alias("sentence"), at(h, h["begin"]).alias("first"), at(h, h["end"]).alias("last")
    )
    return own.select("doc_id", F.size("__s").cast("bigint").alias("n_sentences"), F.transform("__h", told).alias("hits"))


def _next(hits: Column, name: str, gap: int) -> Callable[[Column], Column]:
    """Moves the end of a match to the nearest hit of an identifier within the gap, or to null."""

    def step(match: Column) -> Column:
        near = F.filter(
            hits,
            lambda y: (y["sentence"] == name) & (y["first"] > match["last"]) & (y["first"] <= match["last"] + gap + 1),
        )
        last = F.array_min(F.transform(near, lambda y: y["last"]))
        return F.struct(match["first"].alias("first"), last.alias("last"))

    return step


def _starts(hits: Column, rule: list[str], gap: int) -> Column:
    """Places where a rule starts: each further identifier follows within the gap, the nearest one first."""
    at = F.transform(
        F.filter(hits, lambda x: x["sentence"] == rule[0]),
        lambda x: F.struct(x["place"].alias("first"), x["last"].alias("last")),
    )
    for name in rule[1:]:
        at = F.filter(F.transform(at, _next(hits, name, gap)), lambda x: x["last"].isNotNull())
    return F.transform(at, lambda x: x["first"])


def recognise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalog=SENTENCES, rules=RULES, gap: int = GAP
) -> DataFrame:
    """``(doc_id, n_sentences, hits, licenses)``; a licence is a struct (license, first_place, n_places).

    Licences come in order of their first place, then by name.
    """
    found = known(docs, id_col, text_col, catalog)
    listed = []
    for name in dict.fromkeys(n for n, _ in rules):
        places = F.array_distinct(F.flatten(F.array(*(_starts(F.col("hits"), r, gap) for n, r in rules if n == name))))
        listed.append(
            F.struct(
                F.array_min(places).alias("first_place"),
                F.lit(name).alias("license"),
                F.size(places).alias("n_places"),
            )
        )
    none = F.array().cast("array<struct<first_place:int,license:string,n_places:int>>")
    licences = F.array_sort(F.filter(F.array(*listed), lambda x: x["n_places"] > 0))
    return found.withColumn("licenses", F.when(F.size("hits") > 0, licences).otherwise(none))
