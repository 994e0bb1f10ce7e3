"""License scans: ordered signature rules behind a keyword gate.

Every rule is a regular expression over a text's lower-cased words (runs of
digits, letters and non-ASCII characters) joined by single spaces.  A rule has a
kind; kinds are ordered: full license text, SPDX tag, notice, address, mention.
A cheap search for a few stems decides whether a text is looked at closely, and
each rule runs only where its own stem occurs.  A detection that lies within
the interval of a detection of the same or a better kind is suppressed (of equal
intervals the earlier rule stays).  Three base phrases are always reported.

Runs text by text in ``mapInArrow``: no shuffle, memory bounded by a batch.

Results: a null or empty text has no words, no label, score 0 and null places; a
null doc_id stays null; repeated rows give repeated results; an empty table gives
no rows; other columns are ignored by ``scan``.  Texts are read whole.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_documents, table
from .text_arrays import steps, text_bytes

#: Base phrases and labels (fixed by the query's contract).
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Kinds in order of priority, with the score of a detection.
KINDS = {"text": 1.0, "tag": 0.95, "notice": 0.9, "address": 0.8, "mention": 0.6}

#: label: (names in prose, SPDX identifiers as words, addresses as words, sentences of the license's own text)
LICENSES: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "mit": (("mit license", "mit licence", "expat license"), ("mit",), ("opensource org licenses? mit", "mit license org"), ("permission is hereby granted free of charge to any person obtaining a copy", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability")),
    "apache-2.0": (("apache license(?: version)? 2 0", "apache 2 0 license", "apache software license 2 0"), ("apache 2 0",), ("apache org licenses license 2 0",), ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide")),
    "apache-1.1": (("apache(?: software)? license(?: version)? 1 1",), ("apache 1 1",), ("apache org licenses license 1 1",), ("this product includes software developed by the apache software foundation",)),
    "bsd-2-clause": (("bsd 2 clause(?: license)?", "simplified bsd license", "freebsd license"), ("bsd 2 clause",), ("opensource org licenses? bsd 2 clause",), ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided",)),
    "bsd-3-clause": (("bsd 3 clause(?: license)?", "new bsd license", "modified bsd license", "revised bsd license"), ("bsd 3 clause",), ("opensource org licenses? bsd 3 clause",), ("neither the name of (?:\\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products",)),
    "bsd-4-clause": (("bsd 4 clause(?: license)?", "original bsd license"), ("bsd 4 clause",), (), ("all advertising materials mentioning features or use of this software must display",)),
    "bsd": (("bsd license", "bsd licence", "berkeley software distribution license"), (), ("opensource org licenses? bsd license",), ("redistribution and use in source and binary forms with or without modification are permitted",)),
    "isc": (("isc license", "internet systems consortium license"), ("isc",), ("opensource org licenses? isc",), ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",)),
    "zlib": (("zlib license", "zlib libpng license"), ("zlib",), ("opensource org licenses? zlib",), ("altered source versions must be plainly marked as such and must not be misrepresented as being the original software",)),
    "gpl-1.0": (("gnu general public license(?: as published by the free software foundation)?(?: version| v)? 1(?: 0)?", "gpl ?v? ?1(?: 0)?"), ("gpl 1 0(?: only| or later)?",), ("gnu org licenses gpl 1 0",), ()),
    "gpl-2.0": (("gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2(?: 0)?", "gpl ?v? ?2(?: 0)?", "gnu gpl ?v? ?2"), ("gpl 2 0(?: only| or later)?",), ("gnu org licenses(?: old licenses)? gpl 2 0",), ("you may copy and distribute verbatim copies of the program s source code as you receive it",)),
    "gpl-3.0": (("gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?", "gpl ?v? ?3(?: 0)?", "gnu gpl ?v? ?3"), ("gpl 3 0(?: only| or later)?",), ("gnu org licenses gpl 3 0",), ("the gnu general public license is a free copyleft license for software and other kinds of works",)),
    "gpl": (("gnu general public licen[sc]e", "gnu gpl"), ("gpl",), ("gnu org licenses gpl", "gnu org copyleft gpl"), ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",)),
    "lgpl-2.0": (("gnu library general public license(?: version| v)? 2(?: 0)?",), ("lgpl 2 0(?: only| or later)?",), ("gnu org licenses(?: old licenses)? lgpl 2 0",), ()),
    "lgpl-2.1": (("gnu lesser general public license(?: version| v)? 2 1", "lgpl ?v? ?2 1"), ("lgpl 2 1(?: only| or later)?",), ("gnu org licenses(?: old licenses)? lgpl 2 1",), ("this license the lesser general public license applies to some specially designated software packages",)),
    "lgpl-3.0": (("gnu lesser general public license(?: version| v)? 3(?: 0)?", "lgpl ?v? ?3(?: 0)?"), ("lgpl 3 0(?: only| or later)?",), ("gnu org licenses lgpl 3 0",), ("this version of the gnu lesser general public license incorporates the terms and conditions of version 3",)),
    "lgpl": (("gnu l(?:esser|ibrary) general public licen[sc]e", "gnu lgpl"), ("lgpl",), ("gnu org licenses lgpl",), ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",)),
    "agpl-3.0": (("gnu affero general public licen[sc]e(?:(?: version| v)? 3(?: 0)?)?", "agpl ?v? ?3(?: 0)?"), ("agpl 3 0(?: only| or later)?",), ("gnu org licenses agpl 3 0", "gnu org licenses agpl"), ("the gnu affero general public license is a free copyleft license for software",)),
    "gfdl": (("gnu free documentation licen[sc]e(?:(?: version| v)? 1 [123])?",), ("gfdl 1 [123](?: only| or later)?",), ("gnu org licenses fdl(?: 1 [123])?", "gnu org copyleft fdl"), ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",)),
    "mpl-1.1": (("mozilla public licen[sc]e(?: version| v)? 1 1", "mpl ?v? ?1 1"), ("mpl 1 1",), ("mozilla org mpl 1 1", "mozilla org mpl mpl 1 1"), ("the contents of this file are subject to the mozilla public license version 1 1",)),
    "mpl-2.0": (("mozilla public licen[sc]e(?: version| v)? 2(?: 0)?", "mpl ?v? ?2(?: 0)?"), ("mpl 2 0",), ("mozilla org mpl 2 0", "mozilla org en us mpl 2 0"), ("this source code form is subject to the terms of the mozilla public license v 2 0",)),
    "epl-1.0": (("eclipse public licen[sc]e(?: version| v)? 1(?: 0)?",), ("epl 1 0",), ("eclipse org legal epl v10",), ("the accompanying program is provided under the terms of this eclipse public license",)),
    "epl-2.0": (("eclipse public licen[sc]e(?: version| v)? 2(?: 0)?",), ("epl 2 0",), ("eclipse org legal epl 2 0", "eclipse org legal epl v20"), ()),
    "cddl-1.0": (("common development and distribution licen[sc]e(?:(?: version| v)? 1(?: 0)?)?",), ("cddl 1 0", "cddl 1 1"), ("opensource org licenses? cddl1",), ("the contents of this file are subject to the terms of the common development and distribution license",)),
    "cpl-1.0": (("common public licen[sc]e(?: version| v)? 1(?: 0)?",), ("cpl 1 0",), ("ibm com developerworks library os cpl",), ()),
    "eupl-1.2": (("european union public licen[sc]e(?:(?: version| v)? 1 [12])?",), ("eupl 1 [12]",), ("joinup ec europa eu (?:\\S+ ){0,6}eupl",), ()),
    "ms-pl": (("microsoft public licen[sc]e",), ("ms pl",), ("opensource org licenses? ms pl",), ()),
    "ms-rl": (("microsoft reciprocal licen[sc]e",), ("ms rl",), ("opensource org licenses? ms rl",), ()),
    "artistic-1.0": (("artistic licen[sc]e 1(?: 0)?",), ("artistic 1 0(?: perl)?",), ("opensource org licenses? artistic license 1 0",), ()),
    "artistic-2.0": (("artistic licen[sc]e 2(?: 0)?",), ("artistic 2 0",), ("opensource org licenses? artistic license 2 0", "perlfoundation org artistic license 2 0"), ("this license establishes the terms under which a given free software package may be copied modified distributed",)),
    "bsl-1.0": (("boost software licen[sc]e(?:(?: version| v)? 1(?: 0)?)?",), ("bsl 1 0",), ("boost org license 1 0",), ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation",)),
    "unlicense": (("the unlicense",), ("unlicense",), ("unlicense org",), ("this is free and unencumbered software released into the public domain",)),
    "wtfpl": (("do what the fuck you want to public licen[sc]e",), ("wtfpl",), ("wtfpl net",), ()),
    "python-2.0": (("python software foundation licen[sc]e", "psf licen[sc]e"), ("python 2 0", "psf 2 0"), ("docs python org (?:\\S+ )?license",), ("this license agreement is between the python software foundation",)),
    "php-3.01": (("php licen[sc]e(?:(?: version| v)? 3 0?1?)?",), ("php 3 01", "php 3 0"), ("php net license",), ("this product includes php software freely available from",)),
    "ruby": (("ruby licen[sc]e", "ruby s licen[sc]e"), ("ruby",), ("ruby lang org en license",), ()),
    "openssl": (("openssl licen[sc]e",), ("openssl",), ("openssl org source license",), ("this product includes software developed by the openssl project for use in the openssl toolkit",)),
    "ofl-1.1": (("sil open font licen[sc]e(?:(?: version| v)? 1 1)?", "open font licen[sc]e"), ("ofl 1 1",), ("scripts sil org ofl", "openfontlicense org"), ("this font software is licensed under the sil open font license",)),
    "cc0-1.0": (("cc0 1 0", "creative commons zero", "cc0 public domain dedication"), ("cc0 1 0",), ("creativecommons org publicdomain zero 1 0",), ("the person who associated a work with this deed has dedicated the work to the public domain",)),
    "cc-by-4.0": (("creative commons attribution 4 0(?: international)?", "cc by 4 0"), ("cc by 4 0",), ("creativecommons org licenses by 4 0",), ()),
    "cc-by-3.0": (("creative commons attribution 3 0(?: unported)?", "cc by 3 0"), ("cc by 3 0",), ("creativecommons org licenses by 3 0",), ()),
    "cc-by-2.0": (("creative commons attribution 2 [05](?: generic)?", "cc by 2 [05]"), ("cc by 2 [05]",), ("creativecommons org licenses by 2 [05]",), ()),
    "cc-by-sa": (("creative commons attribution share ?alike(?: [1234] [05])?", "cc by sa(?: [1234] [05])?"), ("cc by sa [1234] [05]",), ("creativecommons org licenses by sa(?: [1234] [05])?",), ()),
    "cc-by-nc": (("creative commons attribution non ?commercial(?: [1234] [05])?", "cc by nc(?: [1234] [05])?"), ("cc by nc [1234] [05]",), ("creativecommons org licenses by nc(?: [1234] [05])?",), ()),
    "cc-by-nd": (("creative commons attribution no ?deriv(?:ative)?s?(?: [1234] [05])?", "cc by nd(?: [1234] [05])?"), ("cc by nd [1234] [05]",), ("creativecommons org licenses by nd(?: [1234] [05])?",), ()),
    "cc-by-nc-sa": (("creative commons attribution non ?commercial share ?alike(?: [1234] [05])?", "cc by nc sa(?: [1234] [05])?"), ("cc by nc sa [1234] [05]",), ("creativecommons org licenses by nc sa(?: [1234] [05])?",), ()),
    "cc-by-nc-nd": (("creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1234] [05])?", "cc by nc nd(?: [1234] [05])?"), ("cc by nc nd [1234] [05]",), ("creativecommons org licenses by nc nd(?: [1234] [05])?",), ()),
    "creative-commons": (("creative commons licen[sc]e", "creative commons attribution"), (), ("creativecommons org licenses",), ("this work is licensed under a creative commons",)),
    "odbl": (("open (?:data commons open )?database licen[sc]e",), ("odbl 1 0",), ("opendatacommons org licenses odbl",), ()),
    "pddl": (("public domain dedication and licen[sc]e",), ("pddl 1 0",), ("opendatacommons org licenses pddl",), ()),
    "public-domain": (("in the public domain", "into the public domain", "public domain licen[sc]e"), (), ("creativecommons org (?:licenses )?publicdomain",), ("this work has been identified as being free of known restrictions under copyright law",)),
    "ncsa": (("university of illinois ncsa open source licen[sc]e", "ncsa licen[sc]e"), ("ncsa",), ("opensource org licenses? ncsa",), ()),
    "postgresql": (("postgresql licen[sc]e",), ("postgresql",), ("postgresql org about licen[sc]e",), ()),
    "upl-1.0": (("universal permissive licen[sc]e(?:(?: version| v)? 1(?: 0)?)?",), ("upl 1 0",), ("oss oracle com licenses upl",), ()),
    "afl-3.0": (("academic free licen[sc]e(?:(?: version| v)? 3(?: 0)?)?",), ("afl 3 0",), ("opensource org licenses? afl 3 0",), ()),
    "osl-3.0": (("open software licen[sc]e(?:(?: version| v)? 3(?: 0)?)?",), ("osl 3 0",), ("opensource org licenses? osl 3 0",), ()),
    "elastic-2.0": (("elastic licen[sc]e(?:(?: version| v)? 2(?: 0)?)?",), ("elastic 2 0",), ("elastic co licensing elastic license",), ()),
    "sspl-1.0": (("server side public licen[sc]e(?:(?: version| v)? 1)?",), ("sspl 1 0",), ("mongodb com licensing server side public license",), ()),
    "busl-1.1": (("business source licen[sc]e(?:(?: version| v)? 1 1)?",), ("busl 1 1",), ("mariadb com bsl11",), ()),
    "proprietary": (("proprietary licen[sc]e", "proprietary and confidential", "commercial licen[sc]e"), (), (), ("unauthorized copying of this file via any medium is strictly prohibited", "no part of this (?:publication|book|work) may be reproduced")),
    "copyright": (("copyright(?: c)? (?:19|20)[0-9][0-9]",), (), (), ()),
}

#: Parts of single words; a text without any of these holds no base phrase and matches no rule.
STEMS = ("licen", "copyright", "reserved", "cc", "spdx", "domain", "gpl", "gnu", "mpl", "apache", "warranty", "permission", "permitted", "redistribut", "software", "copies", "advertising", "contributor", "endorse", "reproduced", "proprietary", "copying", "opensource", "creative", "wtfpl", "perpetual", "bsd", "mongodb", "mariadb", "opendatacommons", "eupl", "openfont", "scripts", "eclipse", "ibm", "deed", "joinup")


def _rules() -> list[tuple[str, str, int, str]]:
    """(label, kind, place in KINDS, expression) in order."""
    found = []
    for label, (names, tags, addresses, sentences) in LICENSES.items():
        found += [(label, "text", s) for s in sentences]
        found += [(label, "tag", f"spdx license identifier {t}") for t in tags]
        found += [(label, "notice", f"(?:licen[sc]ed|released|distributed|published|available|covered) (?:under|by) (?:the )?(?:terms of (?:the )?)?{n}") for n in names]
        found += [(label, "address", a) for a in addresses]
        found += [(label, "mention", n) for n in names]
    kinds = list(KINDS)
    return sorted(((label, kind, kinds.index(kind), s) for label, kind, s in found), key=lambda r: r[2])


def _stem(expression: str) -> str:
    """The longest plain run of the expression: a text without it cannot match."""
    plain = re.sub(r"\((?:[^()]|\([^()]*\))*\)\??|\[[^\]]*\]\??|\\S\S*|.\?|\{[^}]*\}", "\0", expression)
    return max((p.strip() for p in plain.split("\0")), key=len)


RULES = _rules()
_COMPILED: list[tuple[str, str, int, str, re.Pattern]] = []


def compiled() -> list[tuple[str, str, int, str, re.Pattern]]:
    if not _COMPILED:
        _COMPILED.extend((label, kind, rank, _stem(s), re.compile(f"(?<= ){s}(?= )")) for label, kind, rank, s in RULES)
    return _COMPILED


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD_BYTE = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
_STEMS = tuple(s.encode() for s in STEMS)


def suppressed(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of detections (rank, start, end, rule), those not within one of the same or a better rank."""
    kept: list[tuple[int, int, int, int]] = []
    better: list[tuple[int, int, int, int]] = []
    for rank in sorted({f[0] for f in found}):
        better.sort(key=lambda f: f[1])
        starts, ends, most = [f[1] for f in better], [], -1
        for f in better:
            ends.append(most := max(most, f[2]))
        most, mine = -1, []
        for f in sorted((f for f in found if f[0] == rank), key=lambda f: (f[1], -f[2], f[3])):
            k = bisect.bisect_right(starts, f[1])
            if f[2] > most and not (k and ends[k - 1] >= f[2]):
                mine.append(f)
            most = max(most, f[2])
        kept += mine
        better += mine
    return kept


def look(lowered: bytes) -> tuple[list[tuple[str, int]], list[tuple[str, str, int, int]]]:
    """Base places (label, word) and detections (label, kind, first word, last word) of a text."""
    joined = " " + " ".join(w.decode() for w in _WORD.findall(lowered)) + " "
    places, at = [], None
    for phrase, label in BASE:
        k = joined.find(f" {phrase} ")
        while k >= 0:
            places.append((label, k))
            k = joined.find(f" {phrase} ", k + 1)
    found = []
    for n, (_, _, rank, stem, expression) in enumerate(compiled()):
        if stem in joined:
            found += [(rank, m.start(), m.end(), n) for m in expression.finditer(joined)]
    if not places and not found:
        return [], []
    at = [i for i, c in enumerate(joined) if c == " "]
    word = lambda k: bisect.bisect_left(at, k)
    rules = compiled()
    return [(label, word(k)) for label, k in places], [(rules[n][0], rules[n][1], word(a) - 1, word(b) - 1) for _, a, b, n in suppressed(found)]


SCHEMA = "doc_id long, n_words long, base array<struct<label:string,word:long>>, detections array<struct<label:string,kind:string,first_word:long,last_word:long>>"
_BASE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_FOUND = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch, "text"):
            data, offsets = text_bytes(part["text"])
            is_word = _WORD_BYTE[data]
            first = is_word.copy()
            first[1:] &= ~is_word[:-1]
            begins = offsets[:-1][offsets[:-1] < len(data)]
            first[begins] = is_word[begins]
            total = np.concatenate([[0], np.cumsum(first)])
            n_words = total[offsets[1:]] - total[offsets[:-1]]
            base, found = [], []
            raw = data.tobytes().lower()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = raw[a:b]
                x, y = look(text) if any(s in text for s in _STEMS) else ([], [])
                base.append([{"label": label, "word": w} for label, w in x])
                found.append([{"label": label, "kind": k, "first_word": i, "last_word": j} for label, k, i, j in y])
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n_words, pa.int64()), pa.array(base, _BASE), pa.array(found, _FOUND)], ["doc_id", "n_words", "base", "detections"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places and detections of every text."""
    return as_documents(docs).mapInArrow(_batches, SCHEMA)


def labelled(docs: DataFrame) -> DataFrame:
    """One row a text: counts, places and labels, and the best detection's score."""
    scores = " ".join(f"WHEN exists(detections, d -> d.kind = '{k}') THEN {s}D" for k, s in KINDS.items() if k != "mention")
    return scan(docs).selectExpr(
        "doc_id", "n_words", "cast(size(base) as long) AS n_base",
        "array_min(transform(base, b -> b.word)) AS first_word", "array_max(transform(base, b -> b.word)) AS last_word",
        "array_join(array_sort(array_distinct(transform(base, b -> b.label))), ',') AS base_labels",
        "array_join(array_sort(array_distinct(concat(transform(base, b -> b.label), transform(detections, d -> d.label)))), ',') AS labels",
        f"CASE {scores} WHEN size(base) + size(detections) > 0 THEN {KINDS['mention']}D ELSE 0D END AS score",
        "cast(size(detections) as long) AS n_detections",
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(table(spark, sf_dir, "documents"))
