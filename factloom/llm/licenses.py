"""License scans by ordered signature rules.

Rules are notices and mentions written by hand, and those of a table of license families and sentence forms
(``rules()``: some hundreds of regexes in all), each with keywords that gate it (a form's, and one for each of the
family's names), a label, a weight and a priority. A text whose lowered bytes hold no gate word at all is done
after its words are counted. Others are normalised to words joined by single spaces, the rules whose keyword occurs
are applied, and detections are taken in order of priority, longer first: one that lies within an interval already
taken is suppressed. The base phrases are counted besides, and their labels always stay.

Words are maximal runs of ASCII letters and digits and of all characters beyond ASCII, after A-Z is lowered.

Defined results: null text has no words and no label; repeated rows are scanned one by one; detections of one
priority and length are taken from the left; an empty table gives no row.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm._common import ALNUM, LOWER, text_steps, word_spans

#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: label, names as regexes over space-joined words.
FAMILIES = (
    ("0bsd", ("0bsd", "zero clause bsd", "bsd zero clause")),
    ("afl-3.0", ("academic free(?: license)?(?: v(?:ersion)? ?3(?: 0)?)?",)),
    ("agpl-3.0", ("(?:gnu )?affero general public(?: license)?(?: v(?:ersion)? ?3(?: 0)?)?",)),
    ("apache-1.1", ("apache(?: software)?(?: license)? v(?:ersion)? ?1 1",)),
    ("apache-2.0", ("apache(?: software)?(?: license)?,? v(?:ersion)? ?2(?: 0)?", "apache 2(?: 0)?")),
    ("artistic-2.0", ("artistic(?: license)? (?:v(?:ersion)? ?)?2(?: 0)?",)),
    ("blueoak-1.0.0", ("blue oak model(?: license)?",)),
    ("bsd-2-clause", ("(?:simplified|freebsd|2 clause) bsd", "bsd 2 clause")),
    ("bsd-3-clause", ("(?:new|revised|modified|3 clause) bsd", "bsd 3 clause")),
    ("bsd-4-clause", ("(?:original|old|4 clause) bsd", "bsd 4 clause")),
    ("bsl-1.0", ("boost software(?: license)?(?: v(?:ersion)? ?1(?: 0)?)?",)),
    ("busl-1.1", ("business source(?: license)?(?: 1 1)?",)),
    ("cc-by-4.0", ("creative commons attribution 4 0(?: international)?",)),
    ("cc-by-sa-4.0", ("creative commons attribution share ?alike 4 0(?: international)?",)),
    ("cc-by-nc-4.0", ("creative commons attribution non ?commercial 4 0(?: international)?",)),
    ("cc0-1.0", ("cc0(?: 1 0)?(?: universal)?",)),
    ("cddl-1.0", ("common development and distribution(?: license)?",)),
    ("cecill-2.1", ("cecill(?: free software)?(?: license)?(?: 2 1)?",)),
    ("cpl-1.0", ("common public(?: license)? (?:v(?:ersion)? ?)?1(?: 0)?",)),
    ("ecl-2.0", ("educational community(?: license)?",)),
    ("epl-1.0", ("eclipse public(?: license)? (?:v(?:ersion)? ?)?1(?: 0)?",)),
    ("epl-2.0", ("eclipse public(?: license)? (?:v(?:ersion)? ?)?2(?: 0)?",)),
    ("eupl-1.2", ("european union public(?: licence| license)?",)),
    ("fdl-1.3", ("(?:gnu )?free documentation(?: license)?",)),
    ("gpl-2.0", ("(?:gnu )?general public(?: license)? (?:v(?:ersion)? ?)2(?: 0)?", "gplv2")),
    ("gpl-3.0", ("(?:gnu )?general public(?: license)? (?:v(?:ersion)? ?)3(?: 0)?", "gplv3")),
    ("isc", ("isc",)),
    ("json", ("json",)),
    ("lgpl-2.1", ("(?:gnu )?lesser general public(?: license)? (?:v(?:ersion)? ?)2(?: 1)?",)),
    ("lgpl-3.0", ("(?:gnu )?lesser general public(?: license)?(?: v(?:ersion)? ?3(?: 0)?)?",)),
    ("lppl-1.3", ("latex project public(?: license)?",)),
    ("mit", ("mit", "mit x11", "expat")),
    ("mit-0", ("mit no attribution",)),
    ("mpl-1.1", ("mozilla public(?: license)? (?:v(?:ersion)? ?)?1 1",)),
    ("mpl-2.0", ("mozilla public(?: license)?(?: v(?:ersion)? ?2(?: 0)?)?",)),
    ("ms-pl", ("microsoft public(?: license)?",)),
    ("ncsa", ("(?:university of illinois )?ncsa(?: open source)?",)),
    ("odbl-1.0", ("open database(?: license)?",)),
    ("ofl-1.1", ("sil open font(?: license)?",)),
    ("osl-3.0", ("open software(?: license)? (?:v(?:ersion)? ?)?3(?: 0)?",)),
    ("postgresql", ("postgresql",)),
    ("psf-2.0", ("python software foundation(?: license)?",)),
    ("sspl-1.0", ("server side public(?: license)?",)),
    ("unlicense", ("the unlicense", "unlicense")),
    ("upl-1.0", ("universal permissive(?: license)?",)),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public(?: license)?")),
    ("zlib", ("zlib",)),
    ("zpl-2.1", ("zope public(?: license)?",)),
)
#: Sentence forms around a name, best first: form, gate word besides the names', weight.
FORMS = (
    ("spdx license identifier {id}(?: or later| only)?", "spdx", 0.98),
    ("(?:licensed|released|distributed|available|published) under(?: the terms of)?(?: the)? {name}(?: license| licence)?", "under", 0.9),
    ("(?:permission|rights?) (?:is|are) (?:hereby )?granted under(?: the)? {name}(?: license| licence)?", "granted", 0.9),
    ("see(?: the)?(?: file)? licen[sc]e(?: file)? for(?: the)? {name}", "see", 0.7),
    ("(?:this|the) (?:file|code|software|program|project|work|package) (?:is|uses)(?: under)?(?: the)? {name} licen[sc]e", "licen", 0.9),
    ("{name} licen[sc]e", "licen", 0.8),
)
#: Notices that tell a license without its name: label, gate word, regex, weight.
NOTICES = (
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit", "warrant", "the software is provided as is without warranty of any kind express or implied", 0.6),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("bsd-3-clause", "endorse", "neither the name of .{0,80}? may be used to endorse or promote products derived", 0.9),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license", 0.95),
    ("gpl", "general", "(?:gnu )?general public licen[sc]e", 0.7),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[sc]e", 0.8),
    ("apache", "apache", "apache licen[sc]e", 0.7),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee", 0.95),
    ("proprietary", "reserved", "all rights reserved", 0.3),
    ("proprietary", " and ", "(?:proprietary|confidential) and (?:proprietary|confidential)", 0.5),
    ("public-domain", "domain", "(?:released|dedicated|placed) (?:in)?to the public domain|in the public domain", 0.7),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", 0.3),
)
#: Mentions by identifier, abbreviation or name alone, written by hand: label, gate word, regex, weight.
MENTIONS = (
    ("gpl-1.0", "gpl", "(?:gnu )?gpl ?(?:v|version )?1(?: 0)?(?: only| or later| or newer)?", 0.82),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl ?(?:v|version )?2(?: 0)?(?: only| or later| or newer)?", 0.82),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl ?(?:v|version )?3(?: 0)?(?: only| or later| or newer)?", 0.82),
    ("gpl", "gpl", "gnu gpl(?: licen[sc]ed?)?", 0.72),
    ("gpl", "gpl", "gpl (?:licen[sc]ed?|compatible|compliant|software|code|terms)", 0.65),
    ("gpl", "gpl", "(?:under|of|by)(?: the terms of)? the gpl(?! (?:v|version )?[123])", 0.65),
    ("gpl", "gpl", "(?:released|licen[sc]ed|distributed|available|published)(?: under)?(?: the)? gpl(?! (?:v|version )?[123])", 0.65),
    ("lgpl-2.0", "lgpl", "(?:gnu )?lgpl ?(?:v|version )?2(?: 0)?(?: only| or later| or newer)?", 0.82),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl ?(?:v|version )?2 1(?: only| or later| or newer)?", 0.83),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl ?(?:v|version )?3(?: 0)?(?: only| or later| or newer)?", 0.82),
    ("lgpl", "lgpl", "(?:gnu |the )?lgpl(?: licen[sc]ed?)?", 0.7),
    ("lgpl-2.0", "library general", "(?:gnu )?library general public licen[sc]e", 0.82),
    ("lgpl-2.1", "lesser general", "(?:gnu )?lesser general public licen[sc]e (?:as published by the free software foundation )?(?:v|version )?2 1", 0.86),
    ("agpl-1.0", "agpl", "(?:gnu )?agpl ?(?:v|version )?1(?: 0)?(?: only| or later| or newer)?", 0.82),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl ?(?:v|version )?3(?: 0)?(?: only| or later| or newer)?", 0.82),
    ("agpl", "agpl", "(?:gnu |the )?agpl(?: licen[sc]ed?)?", 0.7),
    ("fdl-1.1", "fdl", "(?:gnu )?g?fdl ?(?:v|version )?1 1", 0.82),
    ("fdl-1.2", "fdl", "(?:gnu )?g?fdl ?(?:v|version )?1 2", 0.82),
    ("fdl-1.3", "fdl", "(?:gnu )?g?fdl ?(?:v|version )?1 3", 0.82),
    ("fdl", "fdl", "gnu fdl", 0.7),
    ("fdl", "fdl", "the gfdl", 0.7),
    ("fdl", "fdl", "gfdl licen[sc]ed?", 0.7),
    ("gpl-2.0", "either version", "either version 2 of the licen[sc]e or (?:at your option )?any later version", 0.9),
    ("gpl-3.0", "either version", "either version 3 of the licen[sc]e or (?:at your option )?any later version", 0.9),
    ("classpath-exception-2.0", "classpath", "(?:with )?(?:the )?classpath exception(?: 2 0)?", 0.82),
    ("mit", "mit", "mit licen[sc]ed", 0.82),
    ("mit", "mit", "(?:licen[sc]ed|released|distributed|available|published) under(?: the)? mit", 0.7),
    ("mit", "mit", "licen[sc]e (?:is )?mit", 0.7),
    ("mit", "x11", "(?:mit )?x11 licen[sc]ed?", 0.8),
    ("mit", "expat", "expat licen[sc]ed?", 0.8),
    ("mit-0", "mit", "mit 0 licen[sc]ed?", 0.83),
    ("apache-1.1", "apache", "apache(?: licen[sc]e)? (?:v|version )?1 1", 0.81),
    ("apache-2.0", "apache", "apache ?2 0(?: licen[sc]ed?)?", 0.81),
    ("apache-2.0", "apache", "apache ?v2(?: 0)?(?: licen[sc]ed?)?", 0.81),
    ("apache-2.0", "apache", "apache(?: software)? licen[sc]e (?:v|version )?2(?: 0)?", 0.84),
    ("apache-2.0", "asl", "asl ?(?:v|version )?2 0", 0.8),
    ("apache-2.0", "apache", "www apache org licenses license 2 0(?: txt)?", 0.92),
    ("apache", "apache", "apache licen[sc]ed", 0.75),
    ("bsd-2-clause", "bsd", "bsd 2 clause(?: licen[sc]ed?)?", 0.84),
    ("bsd-2-clause", "bsd", "(?:2|two) clause bsd(?: licen[sc]ed?)?", 0.84),
    ("bsd-3-clause", "bsd", "bsd 3 clause(?: licen[sc]ed?)?", 0.84),
    ("bsd-3-clause", "bsd", "(?:3|three) clause bsd(?: licen[sc]ed?)?", 0.84),
    ("bsd-4-clause", "bsd", "bsd 4 clause(?: licen[sc]ed?)?", 0.84),
    ("bsd-4-clause", "bsd", "(?:4|four) clause bsd(?: licen[sc]ed?)?", 0.84),
    ("0bsd", "bsd", "0bsd", 0.83),
    ("0bsd", "bsd", "bsd 0 clause", 0.83),
    ("0bsd", "bsd", "bsd zero clause", 0.83),
    ("bsd", "bsd", "bsd(?: style| type| like)? licen[sc]ed?", 0.72),
    ("bsd", "bsd", "(?:licen[sc]ed|released|distributed|available|published) under(?: the terms of)?(?: the| a)? bsd(?! [0234])", 0.7),
    ("mpl-1.0", "mpl", "mpl ?(?:v|version )?1 0", 0.82),
    ("mpl-1.1", "mpl", "mpl ?(?:v|version )?1 1", 0.82),
    ("mpl-2.0", "mpl", "mpl ?(?:v|version )?2(?: 0)?", 0.82),
    ("mpl-2.0", "mozilla", "mozilla public licen[sc]e (?:v|version )?2(?: 0)?", 0.85),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e (?:v|version )?1 1", 0.85),
    ("epl-1.0", "epl", "epl ?(?:v|version )?1 0", 0.82),
    ("epl-2.0", "epl", "epl ?(?:v|version )?2 0", 0.82),
    ("eupl-1.1", "eupl", "eupl ?(?:v|version )?1 1", 0.82),
    ("eupl-1.2", "eupl", "eupl ?(?:v|version )?1 2", 0.82),
    ("cddl-1.0", "cddl", "cddl(?: ?(?:v|version )?1(?: 0)?)?", 0.78),
    ("cddl-1.1", "cddl", "cddl ?(?:v|version )?1 1", 0.82),
    ("cc-by-2.0", "cc by", "cc by 2 0", 0.84),
    ("cc-by-2.0", "commons", "creative commons attribution 2 0", 0.84),
    ("cc-by-2.5", "cc by", "cc by 2 5", 0.84),
    ("cc-by-2.5", "commons", "creative commons attribution 2 5", 0.84),
    ("cc-by-3.0", "cc", "cc by 3 0(?: [a-z]{2})?", 0.84),
    ("cc-by-3.0", "commons", "creative commons attribution 3 0(?: unported)?", 0.84),
    ("cc-by-4.0", "cc", "cc by 4 0", 0.84),
    ("cc-by-4.0", "commons", "creative commons attribution 4 0(?: international)?", 0.84),
    ("cc-by", "commons", "creative commons attribution(?: licen[sc]e)?", 0.7),
    ("cc-by", "cc", "cc by licen[sc]ed?", 0.7),
    ("cc-by", "cc", "(?:under|licen[sc]ed?)(?: a| the)? cc by", 0.7),
    ("cc-by-sa-2.5", "cc", "cc by sa 2 5", 0.86),
    ("cc-by-sa-3.0", "cc", "cc by sa 3 0(?: [a-z]{2})?", 0.86),
    ("cc-by-sa-3.0", "commons", "creative commons attribution share ?alike 3 0(?: unported)?", 0.86),
    ("cc-by-sa-4.0", "cc", "cc by sa 4 0", 0.86),
    ("cc-by-sa-4.0", "commons", "creative commons attribution share ?alike 4 0(?: international)?", 0.86),
    ("cc-by-sa", "cc", "cc by sa(?: licen[sc]ed?)?", 0.75),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike(?: licen[sc]e)?", 0.75),
    ("cc-by-nc-3.0", "cc", "cc by nc 3 0(?: [a-z]{2})?", 0.86),
    ("cc-by-nc-4.0", "cc", "cc by nc 4 0", 0.86),
    ("cc-by-nc-4.0", "commons", "creative commons attribution non ?commercial 4 0(?: international)?", 0.86),
    ("cc-by-nc", "cc", "cc by nc(?: licen[sc]ed?)?", 0.75),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial(?: licen[sc]e)?", 0.75),
    ("cc-by-nd-4.0", "cc", "cc by nd 4 0", 0.86),
    ("cc-by-nd-4.0", "commons", "creative commons attribution no ?deriv(?:ative|ativ|s)?(?:e?s)?(?: works)? 4 0(?: international)?", 0.86),
    ("cc-by-nd", "cc", "cc by nd(?: licen[sc]ed?)?", 0.75),
    ("cc-by-nc-sa-3.0", "cc", "cc by nc sa 3 0(?: [a-z]{2})?", 0.88),
    ("cc-by-nc-sa-4.0", "cc", "cc by nc sa 4 0", 0.88),
    ("cc-by-nc-sa-4.0", "commons", "creative commons attribution non ?commercial share ?alike 4 0(?: international)?", 0.88),
    ("cc-by-nc-sa", "cc", "cc by nc sa(?: licen[sc]ed?)?", 0.78),
    ("cc-by-nc-nd-4.0", "cc", "cc by nc nd 4 0", 0.88),
    ("cc-by-nc-nd-4.0", "commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? 4 0(?: international)?", 0.88),
    ("cc-by-nc-nd", "cc", "cc by nc nd(?: licen[sc]ed?)?", 0.78),
    ("cc0-1.0", "cc", "cc0(?: 1 0)?(?: universal)?", 0.84),
    ("cc0-1.0", "cc", "cc zero", 0.84),
    ("cc0-1.0", "commons", "creative commons zero(?: v?1 0)?(?: universal)?", 0.84),
    ("cc-by-4.0", "creativecommons", "creativecommons org licenses by 4 0", 0.92),
    ("cc-by-3.0", "creativecommons", "creativecommons org licenses by 3 0", 0.92),
    ("cc-by-sa-4.0", "creativecommons", "creativecommons org licenses by sa 4 0", 0.92),
    ("cc-by-sa-3.0", "creativecommons", "creativecommons org licenses by sa 3 0", 0.92),
    ("cc-by-nc-4.0", "creativecommons", "creativecommons org licenses by nc 4 0", 0.92),
    ("cc-by-nc-sa-4.0", "creativecommons", "creativecommons org licenses by nc sa 4 0", 0.92),
    ("cc-by-nc-nd-4.0", "creativecommons", "creativecommons org licenses by nc nd 4 0", 0.92),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0", 0.92),
    ("isc", "isc", "isc licen[sc]ed?", 0.8),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]ed?", 0.8),
    ("unlicense", "unlicense", "unlicense org", 0.84),
    ("unlicense", "unlicense", "the unlicense", 0.84),
    ("wtfpl", "wtfpl", "wtfpl(?: ?v?2)?", 0.84),
    ("bsl-1.0", "bsl", "bsl 1 0", 0.82),
    ("bsl-1.0", "boost", "boost software licen[sc]e(?: 1 0)?", 0.82),
    ("busl-1.1", "bu", "busl 1 1", 0.82),
    ("busl-1.1", "bu", "business source licen[sc]e(?: 1 1)?", 0.82),
    ("ofl-1.1", "ofl", "(?:sil )?ofl(?: ?v?1 1)?", 0.78),
    ("osl-3.0", "osl", "osl ?v?3(?: 0)?", 0.8),
    ("afl-3.0", "afl", "afl ?v?3(?: 0)?", 0.8),
    ("sspl-1.0", "sspl", "sspl(?: ?v?1(?: 0)?)?", 0.82),
    ("ms-pl", "ms", "ms pl licen[sc]ed?", 0.8),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", 0.8),
    ("ms-rl", "ms", "ms rl licen[sc]ed?", 0.8),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e", 0.8),
    ("artistic-1.0", "artistic", "artistic licen[sc]e 1 0", 0.82),
    ("artistic-2.0", "artistic", "artistic (?:licen[sc]e )?2 0", 0.82),
    ("odbl-1.0", "odbl", "odbl(?: ?v?1 0)?", 0.82),
    ("psf-2.0", "psf", "psf licen[sc]e(?: v?2(?: 0)?)?", 0.82),
)
#: A text with none of these holds no rule's keywords; each lies within a word, as other characters than spaces may part words.
GATES = (b"licen", b"spdx", b"permission", b"warrant", b"redistribut", b"endorse", b"reserved", b"proprietary", b"confidential", b"domain", b"copyright", b"gnu", b"under", b"granted", b"gpl", b"fdl", b"x11", b"apache", b"asl", b"bsd", b"mpl", b"epl", b"eupl", b"cddl", b"cc", b"commons", b"wtfpl", b"bsl", b"busl", b"ofl", b"osl", b"afl", b"sspl", b"artistic", b"odbl", b"classpath", b"0bsd")


def _keyword(name: str) -> str:
    """The longest literal that every match of a name's regex holds."""
    while (plain := re.sub(r"\(\?:[^()]*\)\??", "\0", name)) != name:
        name = plain
    return max(re.sub(r".\?", "\0", name).split("\0"), key=len).strip()


def rules() -> list[tuple]:
    """(priority, label, gates, regex, weight), best first; of each gate one keyword must occur."""
    out = []
    for form, gate, weight in FORMS:
        for label, names in FAMILIES:
            name = "(?:" + "|".join(sorted(names, key=len, reverse=True)) + ")"
            ident = re.escape(label.replace("-", " ").replace(".", " "))
            own = () if "{id}" in form else (tuple(map(_keyword, names)),)
            out.append((label, ((gate,), *own), form.format(name=name, id=ident), weight))
    out += [(label, ((word,),), pattern, weight) for label, word, pattern, weight in (*NOTICES, *MENTIONS)]
    return [(i, label, gates, re.compile(rf"(?<!\S)(?:{pattern})(?!\S)"), weight) for i, (label, gates, pattern, weight) in enumerate(sorted(out, key=lambda r: -r[3]))]


_RULES: list = []
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def detect(text: str) -> tuple[list[tuple[int, int, str, float]], list[tuple[int, str]]]:
    """Detections kept (first word, last word + 1, label, weight), and base places (word, label), of a lowered text."""
    if not _RULES:
        _RULES.extend(rules())
    words = _WORD.findall(text)
    line = " ".join(words)
    at = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
    word = lambda i: bisect_left(at, i)
    base = sorted((word(m.start()), label) for phrase, label in BASE if phrase in line for m in re.finditer(rf"(?<!\S)(?={phrase}(?!\S))", line))
    found = []
    known: dict[str, bool] = {}
    for i, label, gates, pattern, weight in _RULES:
        if all(any(known[g] if g in known else known.setdefault(g, g in line) for g in own) for own in gates):
            found += [(i, m.start() - m.end(), m.start(), m.end(), label, weight) for m in pattern.finditer(line)]
    # Intervals taken that lie in no other one: starts and ends both rise, so one lookup tells whether an interval lies in any.
    kept: list[tuple] = []
    starts: list[int] = []
    ends: list[int] = []
    for _, _, a, z, label, weight in sorted(found):
        i = bisect_right(starts, a)
        if i and ends[i - 1] >= z:
            continue
        kept.append((a, z, label, weight))
        lo, hi = bisect_left(starts, a), bisect_right(ends, z)
        starts[lo:hi], ends[lo:hi] = [a], [z]
    return [(word(a), word(z + 1), label, weight) for a, z, label, weight in sorted(kept)], base


def _rows(column: pa.Array):
    for _, _, data, off in text_steps(column):
        low = LOWER[data]
        _, _, first = word_spans(low, off, ALNUM)
        raw = low.tobytes()
        for d, n in enumerate(np.diff(first).tolist()):
            own = raw[off[d] : off[d + 1]]
            if not any(g in own for g in GATES):
                yield n, 0, None, None, "", "", 0.0, []
                continue
            kept, base = detect(own.decode("utf-8", "replace"))
            score = 1 - float(np.prod([1 - k[3] for k in kept])) if kept else 0.5 * bool(base)
            by = sorted({label for _, label in base})
            yield n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(by), ",".join(sorted({*by, *(k[2] for k in kept)})), score, [{"first": k[0], "last": k[1], "label": k[2]} for k in kept]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    kind = docs.schema[id_col].dataType.simpleString()
    kinds = (*(pa.int64(),) * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string())])))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")

    def run(batches):
        for batch in batches:
            cols = list(zip(*_rows(batch.column(1)))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", *names])

    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first:long,last:long,label:string>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op5(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
