"""License scans: ordered signature rules with keyword gates, priorities and interval suppression, in Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base phrases (words of a text, lower case) and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Signature rules: tier, label, keyword that all matches hold, pattern over lower-case words with one space between them,
#: weight. The tier is the priority: wording of a license itself, addresses, notices that grant it, names with a version, names.
LICENSE_TEXTS = (
    (0, "mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software", 0.99),
    (0, "mit", "restriction", "to deal in the software without restriction including without limitation the rights to use copy modify", 0.97),
    (0, "x11", "advertising", "except as contained in this notice the name of (?:[^ ]+ ){1,12}shall not be used in advertising", 0.97),
    (0, "isc", "permission", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 0.98),
    (0, "postgresql", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", 0.98),
    (0, "hpnd", "permission", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted", 0.95),
    (0, "bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 0.97),
    (0, "bsd-3-clause", "endorse", "neither the name of (?:[^ ]+ ){1,20}nor the names of (?:its|their) contributors may be used to endorse or promote products", 0.98),
    (0, "bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.98),
    (0, "bsd-2-clause", "views", "the views and conclusions contained in the software and documentation are those of the authors", 0.9),
    (0, "0bsd", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 0.97),
    (0, "zlib", "liable", "in no event will the authors be held liable for any damages arising from the use of this software", 0.97),
    (0, "zlib", "altered", "altered source versions must be plainly marked as such", 0.95),
    (0, "apache-2", "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at(?: http| https)? www apache org licenses license 2 0", 0.99),
    (0, "apache-2", "reproduction", "terms and conditions for use reproduction and distribution", 0.6),
    (0, "apache-1.1", "apache", "this product includes software developed by the apache software foundation", 0.9),
    (0, "gpl", "gnu", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.99),
    (0, "gpl-2", "gnu", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", 0.99),
    (0, "gpl-3", "gnu", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 0.99),
    (0, "gpl-2", "gnu", "gnu general public license version 2 only as published by the free software foundation", 0.99),
    (0, "gpl-2", "gnu", "gnu general public license version 2 june 1991", 0.99),
    (0, "gpl-3", "gnu", "gnu general public license version 3 29 june 2007", 0.99),
    (0, "gpl", "gnu", "you should have received a copy of the gnu general public license along with this program", 0.95),
    (0, "lgpl", "gnu", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation", 0.99),
    (0, "lgpl-2.1", "gnu", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license", 0.99),
    (0, "lgpl-3", "gnu", "gnu lesser general public license as published by the free software foundation either version 3 of the license", 0.99),
    (0, "lgpl-2", "gnu", "gnu library general public license as published by the free software foundation either version 2 of the license", 0.99),
    (0, "lgpl", "gnu", "you should have received a copy of the gnu lesser general public license along with this library", 0.95),
    (0, "agpl-3", "affero", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", 0.99),
    (0, "mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0", 0.99),
    (0, "mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 0.99),
    (0, "mpl-1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 0", 0.99),
    (0, "epl-1", "eclipse", "made available under the terms of the eclipse public license v(?:ersion)? ?1 0", 0.98),
    (0, "epl-2", "eclipse", "made available under the terms of the eclipse public license v(?:ersion)? ?2 0", 0.98),
    (0, "cpl-1", "common", "this program and the accompanying materials are made available under the terms of the common public license v(?:ersion)? ?1 0", 0.98),
    (0, "cddl-1", "common", "subject to the terms of the common development and distribution license", 0.97),
    (0, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 0.99),
    (0, "wtfpl", "public", "do what the fuck you want to public license", 0.98),
    (0, "boost-1", "boost", "boost software license version 1 0 august 17th 2003", 0.99),
    (0, "boost-1", "boost", "distributed under the boost software license version 1 0", 0.99),
    (0, "cc0", "neighboring", "to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright and related or neighboring rights", 0.98),
    (0, "ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1", 0.99),
    (0, "python-2", "python", "psf license agreement for python", 0.97),
    (0, "openssl", "openssl", "this product includes software developed by the openssl project", 0.95),
    (0, "ms-pl", "governs", "this license governs use of the accompanying software if you use the software you accept this license", 0.9),
    (0, "eupl-1.2", "eupl", "licensed under the eupl version 1 2 or as soon they will be approved", 0.98),
    (0, "beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", 0.95),
    (0, "vim", "vim", "vim is charityware", 0.9),
    (0, "artistic-2", "artistic", "the artistic license 2 0 copyright c 2000 2006 the perl foundation", 0.98),
    (0, "permissive-notice", "permission", "permission is hereby granted free of charge", 0.8),
)
ADDRESSES = (
    (1, "mit", "opensource", "opensource org licenses mit(?: license)?", 0.97),
    (1, "apache-2", "apache", "apache org licenses license 2 0", 0.97),
    (1, "bsd-2-clause", "opensource", "opensource org licenses bsd 2 clause", 0.97),
    (1, "bsd-3-clause", "opensource", "opensource org licenses bsd 3 clause", 0.97),
    (1, "bsd", "opensource", "opensource org licenses bsd license", 0.95),
    (1, "isc", "opensource", "opensource org licenses isc", 0.97),
    (1, "zlib", "opensource", "opensource org licenses zlib", 0.97),
    (1, "gpl-2", "gnu", "gnu org (?:old )?licenses (?:old licenses )?gpl 2 0", 0.97),
    (1, "gpl-3", "gnu", "gnu org licenses gpl 3 0", 0.97),
    (1, "gpl", "gnu", "gnu org licenses gpl", 0.9),
    (1, "lgpl-2.1", "gnu", "gnu org licenses (?:old licenses )?lgpl 2 1", 0.97),
    (1, "lgpl-3", "gnu", "gnu org licenses lgpl 3 0", 0.97),
    (1, "lgpl", "gnu", "gnu org licenses lgpl", 0.9),
    (1, "agpl-3", "gnu", "gnu org licenses agpl(?: 3 0)?", 0.97),
    (1, "mpl-2", "mozilla", "mozilla org mpl 2 0", 0.97),
    (1, "mpl-1.1", "mozilla", "mozilla org mpl mpl 1 1", 0.97),
    (1, "epl-1", "eclipse", "eclipse org legal epl v10", 0.97),
    (1, "epl-2", "eclipse", "eclipse org legal epl (?:v20|2 0)", 0.97),
    (1, "unlicense", "unlicense", "unlicense org", 0.97),
    (1, "cc0", "creativecommons", "creativecommons org publicdomain zero(?: 1 0)?", 0.98),
    (1, "public-domain", "creativecommons", "creativecommons org publicdomain mark(?: 1 0)?", 0.95),
    (1, "cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa(?: [1-4] [05])?", 0.98),
    (1, "cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd(?: [1-4] [05])?", 0.98),
    (1, "cc-by-nc", "creativecommons", "creativecommons org licenses by nc(?: [1-4] [05])?", 0.98),
    (1, "cc-by-nd", "creativecommons", "creativecommons org licenses by nd(?: [1-4] [05])?", 0.98),
    (1, "cc-by-sa", "creativecommons", "creativecommons org licenses by sa(?: [1-4] [05])?", 0.98),
    (1, "cc-by", "creativecommons", "creativecommons org licenses by(?: [1-4] [05])?", 0.98),
    (1, "ofl-1.1", "scripts", "scripts sil org ofl", 0.95),
    (1, "boost-1", "boost", "boost org license 1 0 txt", 0.97),
    (1, "wtfpl", "wtfpl", "wtfpl net", 0.95),
)
NOTICES = (
    (5, "all-rights-reserved", "rights", "all rights reserved", 0.7),
    (5, "proprietary", "confidential", "proprietary and confidential", 0.8),
    (5, "proprietary", "confidential", "confidential and proprietary(?: information)?", 0.8),
    (5, "proprietary", "unauthorized", "unauthorized (?:copying|use|distribution|reproduction)(?: or distribution)?(?: of this (?:file|software|document))? (?:via any medium )?is (?:strictly )?prohibited", 0.85),
    (5, "no-redistribution", "redistribution", "no redistribution (?:is )?(?:permitted|allowed)", 0.7),
    (5, "no-redistribution", "redistribute", "(?:may|must|do|shall) not redistribute", 0.6),
    (5, "no-commercial-use", "commercial", "(?:for )?non ?commercial use only", 0.75),
    (5, "no-commercial-use", "commercial", "not for commercial use", 0.75),
    (5, "no-derivatives", "derivative", "no derivative works(?: are)? (?:permitted|allowed)", 0.7),
    (5, "copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", 0.5),
    (5, "public-domain", "domain", "(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 0.9),
)
#: Names: tier of the bare name (None: the name alone says nothing), label, keyword, pattern.
NAMES = (
    (None, "mit", "mit", "mit(?: x11| expat)?"),
    (None, "x11", "x11", "x11"),
    (None, "isc", "isc", "isc"),
    (None, "zlib", "zlib", "zlib(?: libpng)?"),
    (3, "apache-1.1", "apache", "apache(?: software)? licen[cs]e(?: version| v)? ?1 1"),
    (3, "apache-2", "apache", "apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?"),
    (3, "apache-2", "apache", "apache ?2(?: 0)?"),
    (4, "apache", "apache", "apache(?: software)? licen[cs]e"),
    (3, "bsd-2-clause", "bsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)"),
    (3, "bsd-3-clause", "bsd", "(?:modified bsd|new bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)"),
    (3, "bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)"),
    (None, "bsd", "bsd", "bsd"),
    (4, "bsd", "berkeley", "berkeley software distribution"),
    (3, "gpl-1", "gnu", "gnu (?:general public licen[cs]e|gpl)(?: version| v)? ?1(?: 0)?"),
    (3, "gpl-2", "gnu", "gnu (?:general public licen[cs]e|gpl)(?: version| v)? ?2(?: 0)?(?: only| or later)?"),
    (3, "gpl-3", "gnu", "gnu (?:general public licen[cs]e|gpl)(?: version| v)? ?3(?: 0)?(?: only| or later)?"),
    (4, "gpl", "gnu", "gnu (?:general public licen[cs]e|gpl)"),
    (3, "gpl-2", "gpl", "gpl(?: version)? ?v?2(?: 0)?(?: only| or later)?"),
    (3, "gpl-2", "gplv2", "gplv2"),
    (3, "gpl-3", "gpl", "gpl(?: version)? ?v?3(?: 0)?(?: only| or later)?"),
    (3, "gpl-3", "gplv3", "gplv3"),
    (None, "gpl", "gpl", "gpl"),
    (3, "lgpl-2.1", "lgpl", "lgpl(?: version)? ?v?2 1(?: only| or later)?"),
    (3, "lgpl-3", "lgpl", "lgpl(?: version)? ?v?3(?: 0)?(?: only| or later)?"),
    (None, "lgpl", "lgpl", "lgpl"),
    (3, "lgpl-2.1", "lesser", "gnu lesser general public licen[cs]e(?: version| v)? ?2 1"),
    (3, "lgpl-3", "lesser", "gnu lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    (4, "lgpl", "lesser", "gnu lesser general public licen[cs]e"),
    (3, "lgpl-2", "library", "gnu library general public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    (4, "lgpl", "library", "gnu library general public licen[cs]e"),
    (3, "agpl-3", "affero", "gnu affero general public licen[cs]e(?:(?: version| v)? ?3(?: 0)?)?"),
    (3, "agpl-3", "agpl", "agpl ?v?3(?: 0)?(?: only| or later)?"),
    (None, "agpl-3", "agpl", "agpl"),
    (3, "fdl-1.3", "documentation", "gnu free documentation licen[cs]e(?:(?: version| v)? ?1(?: [1-3])?)?"),
    (3, "mpl-1.1", "mozilla", "mozilla public licen[cs]e(?: version| v)? ?1 1"),
    (3, "mpl-2", "mozilla", "mozilla public licen[cs]e(?:(?: version| v)? ?2(?: 0)?)?"),
    (3, "mpl-1.1", "mpl", "mpl(?: version| v)? ?1 1"),
    (3, "mpl-2", "mpl", "mpl(?: version| v)? ?2(?: 0)?"),
    (None, "mpl-2", "mpl", "mpl"),
    (3, "epl-1", "eclipse", "eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?"),
    (3, "epl-2", "eclipse", "eclipse public licen[cs]e(?:(?: version| v)? ?2(?: 0)?)?"),
    (3, "eupl-1.2", "eupl", "eupl(?: version| v)? ?1 2"),
    (3, "cddl-1", "cddl", "cddl(?: version| v)? ?1(?: [01])?"),
    (4, "cddl-1", "distribution", "common development and distribution licen[cs]e"),
    (None, "cddl-1", "cddl", "cddl"),
    (3, "artistic-2", "artistic", "artistic licen[cs]e(?: version| v)? ?2(?: 0)?"),
    (4, "artistic", "artistic", "artistic licen[cs]e"),
    (3, "boost-1", "boost", "boost software licen[cs]e(?:(?: version| v)? ?1(?: 0)?)?"),
    (3, "ms-pl", "microsoft", "microsoft public licen[cs]e"),
    (3, "upl-1", "universal", "universal permissive licen[cs]e(?:(?: version| v)? ?1(?: 0)?)?"),
    (4, "unlicense", "unlicense", "unlicense"),
    (4, "wtfpl", "wtfpl", "wtfpl"),
    (3, "cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    (3, "cc-by-nc-sa", "cc", "cc by nc sa(?: [1-4](?: [05])?)?"),
    (3, "cc-by-nc-nd", "cc", "cc by nc nd(?: [1-4](?: [05])?)?"),
    (3, "cc-by-nc", "cc", "cc by nc(?: [1-4](?: [05])?)?"),
    (3, "cc-by-sa", "cc", "cc by sa(?: [1-4](?: [05])?)?"),
    (3, "cc-by-nd", "cc", "cc by nd(?: [1-4](?: [05])?)?"),
    (3, "cc-by", "cc", "cc by(?: [1-4](?: [05])?)?"),
    (3, "cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike(?: [1-4](?: [05])?)?"),
    (3, "cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4](?: [05])?)?"),
    (3, "cc-by-nc", "creative", "creative commons attribution non ?commercial(?: [1-4](?: [05])?)?"),
    (3, "cc-by-sa", "creative", "creative commons attribution share ?alike(?: [1-4](?: [05])?)?"),
    (3, "cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative)?s?(?: [1-4](?: [05])?)?"),
    (3, "cc-by", "creative", "creative commons attribution(?: [1-4](?: [05])?)?"),
    (3, "odbl", "database", "open (?:data commons open )?database licen[cs]e(?:(?: version| v)? ?1(?: 0)?)?"),
    (3, "ofl-1.1", "font", "(?:sil )?open font licen[cs]e(?:(?: version| v)? ?1 1)?"),
    (3, "python-2", "python", "python software foundation licen[cs]e(?:(?: version| v)? ?2(?: 0)?)?"),
    (None, "postgresql", "postgresql", "postgresql"),
    (None, "public-domain", "domain", "public domain"),
)
#: What stands before a name that grants the license, and behind one that needs it.
GRANT = (
    "(?:spdx license identifier "
    "|(?:(?:licen[cs]ed|released|distributed|available|published|provided|offered|shared) )?(?:to you )?under (?:the terms of )?(?:a |an |the )?"
    "|(?:covered|governed) by (?:the terms of )?(?:a |an |the )?"
    "|(?:released|placed) (?:in|into) (?:the )?)"
)
BEHIND = "(?: style)? licen[cs]e"


def expansions(pattern: str) -> list[str]:
    """What a pattern of the tables matches, each choice once: alternatives and options are spelled out, `[^ ]+` is x, and what
    repeats stands once."""
    alternatives, current, i = [], [""], 0
    while i < len(pattern):
        if pattern[i] == "|":
            alternatives += current
            current, i = [""], i + 1
            continue
        if pattern.startswith("(?:", i):
            depth, j = 1, i + 3
            while depth:
                depth += {"(": 1, ")": -1}.get(pattern[j], 0)
                j += 1
            unit = expansions(pattern[i + 3 : j - 1])
        elif pattern[i] == "[":
            j = pattern.index("]", i) + 1
            unit = ["x"] if pattern[i + 1] == "^" else [pattern[i + 1], pattern[j - 2]]
        else:
            unit, j = [pattern[i]], i + 1
        if pattern[j : j + 1] == "?":
            unit, j = [*unit, ""], j + 1
        elif pattern[j : j + 1] == "+":
            j += 1
        elif pattern[j : j + 1] == "{":
            j = pattern.index("}", j) + 1
        current, i = [a + u for a in current for u in unit], j
    return alternatives + current


def gate(keyword: str, pattern: str) -> str:
    """The keyword as it stands in all matches of the pattern: with the space before and behind it where all have that."""
    texts = [f" {x} " for x in expansions(pattern)]
    for form in (f" {keyword} ", f" {keyword}", f"{keyword} ", keyword):
        if all(form in t for t in texts):
            return form
    raise ValueError(f"{keyword} is not in all matches of {pattern}")


def rules() -> list[dict]:
    """All rules in order of priority: signatures as they stand; each name where words before it grant the license, where
    `license` follows, and alone if that says enough. A rule's gate is what all of its matches hold."""
    out = [(t, label, gate(word, pattern), pattern, weight) for t, label, word, pattern, weight in (*LICENSE_TEXTS, *ADDRESSES)]
    for tier, label, word, name in NAMES:
        held = gate(word, name)
        out.append((2, label, held, f"{GRANT}{name}(?:{BEHIND})?", 0.95))
        if tier is None:
            out.append((4, label, held, f"(?:the )?{name}{BEHIND}", 0.85))
        else:
            out.append((tier, label, held, f"(?:the )?{name}(?:{BEHIND})?", 0.9 if tier == 3 else 0.8))
    out += [(t, label, gate(word, pattern), pattern, weight) for t, label, word, pattern, weight in NOTICES]
    out = sorted(out, key=lambda r: r[0])  # stable: rules of a tier keep their order
    return [{"tier": t, "label": label, "gate": held, "pattern": f" {pattern}(?= )", "weight": w} for t, label, held, pattern, w in out]


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Letters A-Z are lower-cased; words are runs of digits, letters and characters beyond ASCII. Base phrases count
    wherever their words stand consecutively. A rule is tried if the text holds its keyword. Detections are taken by
    tier, the longer first within a tier, then the earlier; one that shares words with a taken one, inside it or across its
    border, is suppressed. score is the greatest weight of what remains, 0.95 at least where a base phrase stands, 0 without
    any. Null and empty texts have no words and no labels; repeated rows are judged each; further columns are ignored; an
    empty table gives an empty result.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col(id_col).alias("id"), F.regexp_replace(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ").alias("t"))
    rows = rows.select("id", F.concat(F.lit(" "), F.trim("t"), F.lit(" ")).alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split("t", " "), ""))
    table = rules()
    none = F.array().cast("array<int>")
    at = F.sequence(F.lit(0), F.size("w") - 1)
    base = {label: F.when(F.contains("t", F.lit(f" {phrase} ")), F.filter(at, _stands(phrase.split()))).otherwise(none) for phrase, label in BASE}
    gates = {r["gate"] for r in table}
    first = "|".join(sorted(g[1:] for g in gates if g[0] == " "))
    inside = "|".join(sorted(g for g in gates if g[0] != " "))
    gated = F.col("t").rlike(f" (?:{first})|{inside}" if inside else f" (?:{first})")
    rows = rows.select("id", "t", "w", *[v.alias(f"b{i}") for i, v in enumerate(base.values())], F.when(gated, F.expr(_matches(table))).alias("m"))
    rows = rows.withColumn("d", F.flatten(F.transform("m", lambda m: _placed(m, table))))
    rows = rows.withColumn("k", F.flatten(F.transform(_clusters(F.col("d")), _kept)))
    names = [F.when(F.size(f"b{i}") > 0, F.lit(label)) for i, label in enumerate(base)]
    rows = rows.withColumn("bl", F.array_sort(F.array_compact(F.array(*names)))).withColumn("p", F.concat("b0", "b1", "b2"))
    found = F.coalesce(F.transform("k", lambda k: k["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("k", lambda k: k["weight"])), F.lit(0.0))
    return rows.select(
        F.col("id").alias(id_col),
        F.size("w").cast("long").alias("n_words"),
        F.size("p").cast("long").alias("n_base"),
        F.array_min("p").cast("long").alias("first_word"),
        F.array_max("p").cast("long").alias("last_word"),
        F.array_join("bl", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("bl", found)), ",").alias("labels"),
        F.greatest(best, F.when(F.size("p") > 0, F.lit(0.95)).otherwise(F.lit(0.0))).alias("score"),
    )


def _matches(table: list[dict]) -> str:
    """SQL of an array of (rule, hits, what stands between them) of the rules that match: first by keyword, then one
    constant pattern for each rule."""
    gates: dict[str, list[str]] = {}
    for i, r in enumerate(table):
        p = r["pattern"]
        gates.setdefault(r["gate"], []).append(f"CASE WHEN t RLIKE '{p}' THEN named_struct('rule', {i}, 'hits', regexp_extract_all(t, '{p}', 0), 'between', split(t, '{p}', -1)) END")
    parts = [f"CASE WHEN contains(t, '{gate}') THEN array_compact(array({', '.join(found)})) END" for gate, found in gates.items()]
    return f"flatten(array_compact(array({', '.join(parts)})))"


def _placed(m: Column, table: list[dict]) -> Column:
    """Detections of a rule: tier, minus_words (so that longer ones sort first), start, end, label, weight; places count words."""
    of = lambda name, cut="{}": F.get(F.expr(f"array({', '.join(cut.format(r[name]) for r in table)})"), m["rule"])
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    pairs = F.zip_with(F.slice(m["between"], 1, F.size(m["hits"])), m["hits"], lambda s, h: F.struct(spaces(s).alias("before"), spaces(h).alias("words")))
    def places(pairs: Column) -> Column:
        before = _before(F.transform(pairs, lambda x: x["before"] + x["words"]), lambda a, x: a + x)
        return F.zip_with(pairs, before, lambda x, at: F.struct((at + x["before"]).alias("start"), x["words"].alias("words")))

    found = lambda x: F.struct(of("tier").alias("tier"), (-x["words"]).alias("minus_words"), x["start"].alias("start"), (x["start"] + x["words"]).alias("end"), of("label", "'{}'").alias("label"), of("weight", "{}D").alias("weight"))
    return F.transform(_once(pairs, places), found)


def _once(value: Column, body) -> Column:
    """body(value) with the value worked out once: Spark works out an expression again wherever it stands inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, merge, size: int = 64) -> Column:
    """For each element of an array of numbers what those before it merge to (0 at first). Runs of `size` are merged first, so that
    a long array does not grow one by one."""
    zero = F.lit(0)
    fold = lambda array, start: F.aggregate(array, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct(merge(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    runs = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.size(v) / size).cast("int")) - 1), lambda b: F.slice(v, b * size + 1, F.lit(size)))
    over = lambda r: F.flatten(F.zip_with(r, fold(F.transform(r, lambda x: F.aggregate(x, zero, merge)), zero), fold))
    return _once(values, lambda v: _once(runs(v), over))


def _clusters(d: Column) -> Column:
    """Detections in arrays of those that overlap or are joined by others: what is suppressed depends on one's own array only, so a
    long text costs no more than the arrays' sizes squared. A cluster begins where all before it have ended."""
    by_start = F.transform(F.sort_array(F.transform(d, lambda x: F.struct(x["start"].alias("at"), x.alias("d")))), lambda x: x["d"])

    def heads(s: Column) -> Column:
        marked = F.zip_with(s, _before(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x)), lambda x, r: x["start"] >= r)
        return F.filter(F.transform(marked, lambda m, i: F.when(m, i + 1)), lambda i: i.isNotNull())

    def cut(s: Column, h: Column) -> Column:
        ends = F.concat(F.slice(h, 2, F.greatest(F.lit(1), F.size(h))), F.array(F.size(s) + 1))
        return F.zip_with(h, ends, lambda a, z: F.slice(s, a, z - a))

    return _once(by_start, lambda s: _once(heads(s), lambda h: cut(s, h)))


def _kept(d: Column) -> Column:
    """Of one cluster what is taken: by tier, the longer first, then the earlier, unless it shares words with a taken one."""
    meets = lambda a, x: F.exists(a, lambda k: (x["start"] < k["end"]) & (k["start"] < x["end"]))
    none = F.filter(d, lambda x: F.lit(False))
    return F.when(F.size(d) == 1, d).otherwise(F.aggregate(F.sort_array(d), none, lambda a, x: F.when(meets(a, x), a).otherwise(F.array_append(a, x))))


def _stands(phrase: list[str]):
    def test(i: Column) -> Column:
        out = F.get("w", i) == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            out &= F.get("w", i + k) == word
        return F.coalesce(out, F.lit(False))

    return test
