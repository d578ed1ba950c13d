"""Licence scans by sentence rules.

Texts are unwrapped (comment marks stripped, the lines of a paragraph joined), cut into
sentences, and each is brought to a normal form of plain words. A normal form is mapped to
the identifier of a known licence sentence, by lookup of whole titles first, then by the
phrases of ``SENTENCES``; the sequence of identifiers is then matched, from the left and by the
longest rule first, against ordered rules that name licences by their SPDX names. The
title of a whole licence text takes up the mentions of its own family that the text holds.
Sentences that speak of a licence without being known give UNKNOWN.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_text_columns

#: SPDX names of licences and exceptions, as they are written.
SPDX = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0
BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1
CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0
CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 ClArtistic CPL-1.0 curl ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL
GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND ICU IJG IPL-1.0 ISC
LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later Libpng LPPL-1.3c
MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby
SGI-B-2.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
Classpath-exception-2.0 GCC-exception-3.1 LLVM-exception Autoconf-exception-3.0 Bison-exception-2.2 Linux-syscall-note OpenSSL-exception
""".split()
#: Known sentences, as phrases of the normal form. Order matters: the first that is found names a sentence.
SENTENCES = (
    ("text:Apache-2.0", r"^apache license version 2\.0 january 2004"),
    ("text:AGPL-3.0", r"^gnu affero general public license version 3 19 november 2007"),
    ("text:LGPL-3.0", r"^gnu lesser general public license version 3 29 june 2007"),
    ("text:LGPL-2.1", r"^gnu lesser general public license version 2\.1 february 1999"),
    ("text:LGPL-2.0", r"^gnu library general public license version 2 june 1991"),
    ("text:GPL-3.0", r"^gnu general public license version 3 29 june 2007"),
    ("text:GPL-2.0", r"^gnu general public license version 2 june 1991"),
    ("text:GPL-1.0", r"^gnu general public license version 1 february 1989"),
    ("text:GFDL-{version}", r"^gnu free documentation license version (?P<version>1\.[123]) "),
    ("text:MPL-{version}", r"^mozilla public license version (?P<version>1\.1|2\.0)( [0-9. ]*definitions| -+| =+)?$"),
    ("text:EPL-{version}", r"^eclipse public license (- )?version (?P<version>[12]\.0)$"),
    ("text:CC0-1.0", r"^(creative commons( legal code)? )?cc0 1\.0 universal"),
    ("text:CC-{name}-{version}", r"^(creative commons )?(?P<name>attribution[a-z -]*?) (?P<version>[1-4]\.[05]) (international|unported|generic)( public license)?$"),
    ("text:BSL-1.0", r"^boost software license - version 1\.0"),
    ("text:Artistic-2.0", r"^(the )?artistic license 2\.0"),
    ("text:Artistic-1.0", r"^the artistic license( preamble)?$"),
    ("text:WTFPL", r"do what the fuck you want to public license"),
    ("text:OFL-1.1", r"sil open font license version 1\.1"),
    ("text:Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("spdx", r"^spdx-license-identifier (?P<name>.+)"),
    ("apache-2", r"licensed under (the terms of )?the apache license,? version 2(\.0)?|under the apache(-| license )2(\.0)?( license)?\b|under apache license 2"),
    ("apache-compliance", r"you may not use this file except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at"),
    ("apache-as-is", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-see", r"see the license for the specific language governing permissions and limitations"),
    ("mit-named", r"(released|licensed|available|distributed|provided|published) under (the terms of )?(the |an? )?mit( open source)?( style)? license|^(the )?mit license( mit)?$"),
    ("bsl-grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this (software|font|library)"),
    ("mit-notice", r"the above copyright notice and this permission notice (including the next paragraph )?shall be included in all copies"),
    ("mit-as-is", r"the software is provided as is without warranty of any kind express or implied|the software is provided as is without warranty of any kind$"),
    ("mit-liability", r"in no event shall the [a-z0-9 ]*be liable for any claim damages or other liability"),
    ("isc-grant", r"permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted( provided| without|$)"),
    ("isc-as-is", r"the software is provided as is and [a-z0-9 .]+ disclaims? all warranties"),
    ("isc-liability", r"in no event shall [a-z0-9 .]+ be liable for any special direct indirect or consequential damages"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", r"redistributions of source code must retain the (above )?copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the (above )?copyright notice"),
    ("bsd-advert", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-endorse", r"neither the names? of .{1,200} may be used to endorse or promote products|the names? .{1,200} may not be used to endorse or promote products"),
    ("bsd-as-is", r"this software is provided by .{1,200} as is and any express or implied warranties"),
    ("bsd-liability", r"in no event shall .{1,200} be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd-named", r"(released|licensed|available|distributed) under (the terms of )?(the |a )?((?P<name>[0234])-clause |new |modified |simplified )?bsd( (?P<other>[0234])-clause)?( style)? license"),
    ("zlib-as-is", r"this software is provided as is without any express or implied warranty"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib-origin", r"the origin of this software must not be misrepresented"),
    ("zlib-marked", r"altered source versions must be plainly marked"),
    ("mpl-notice", r"subject to the terms of the mozilla public license version (?P<version>[12]\.[01])|licensed under (the terms of )?the mozilla public license( version)? (?P<other>[12]\.[01])"),
    ("epl-named", r"(terms of|licensed under|available under|released under) the eclipse public license( -)?( version)? (?P<version>[12]\.0)"),
    ("gnu-fdl", r"under the terms of the gnu free documentation license"),
    ("gnu-hope", r"(program|library|software|file|package|work) is distributed in the hope that it will be useful but without any warranty"),
    ("gnu-copy", r"you should have received a copy of the gnu (affero |lesser |library )?general public license"),
    ("gnu-named", r"(under|of)( either)?( the)?( terms (and conditions )?of)?( either)?( the)? (gnu (?P<kind>affero |lesser |library )?general public license|(gnu )?(?P<short>a|l)?gpl\b)"),
    ("cc0", r"(released|licensed|available|dedicated|waived) .{0,60}(cc0|creative commons zero)|under cc0"),
    ("cc-named", r"(licensed|released|available|distributed|published) under (the terms of )?(a |an |the )?(cc|creative commons)[ -](?P<name>(attribution|by)[a-z -]*?)(license )?[ -]?(?P<version>[1-4]\.[05])?( international| unported| generic)?( license.*)?$"),
    ("wtfpl-named", r"under (the terms of )?the (wtfpl|do what the fuck)"),
    ("unlicense-named", r"under the unlicense"),
    ("isc-named", r"under (the terms of )?the isc license"),
    ("zlib-named", r"under (the terms of )?the zlib license"),
    ("public-domain", r"(released|placed|put|dedicated) (in|into|to) the public domain"),
    ("all-rights", r"all rights reserved"),
    ("copyright", r"^(c )?copyright |^copyright$"),
)
#: Rules as (licence, identifiers in order); {name} and {version} are what a sentence names.
RULES = (
    ("Apache-2.0", ("apache-2", "apache-compliance", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-2", "apache-compliance", "apache-copy")),
    ("Apache-2.0", ("apache-2",)),
    ("MIT", ("mit-named", "mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT-0", ("mit-grant", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-named",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("ISC", ("isc-grant", "isc-as-is", "isc-liability")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant", "mit-as-is")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-named",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-{name}-Clause", ("bsd-named",)),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin", "zlib-marked")),
    ("Zlib", ("zlib-grant", "zlib-origin", "zlib-marked")),
    ("Zlib", ("zlib-named",)),
    ("{name}", ("gnu-named", "gnu-hope", "gnu-copy")),
    ("{name}", ("gnu-named", "gnu-hope")),
    ("{name}", ("gnu-named",)),
    ("GFDL", ("gnu-fdl",)),
    ("MPL-{version}", ("mpl-notice",)),
    ("EPL-{version}", ("epl-named",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-{name}-{version}", ("cc-named",)),
    ("WTFPL", ("wtfpl-named",)),
    ("Unlicense", ("unlicense-named",)),
    ("public-domain", ("public-domain",)),
    ("all-rights-reserved", ("all-rights",)),
)
#: What the title of a whole text takes up behind it, as beginnings of identifiers.
TAKEN = {"GPL": ("gnu",), "LGPL": ("gnu",), "AGPL": ("gnu",), "GFDL": ("gnu",), "Apache": ("apache",), "MPL": ("mpl", "gnu"), "EPL": ("epl", "gnu"), "CC0": ("cc", "public"), "CC": ("cc", "public"), "Unlicense": ("public", "mit"), "WTFPL": ("wtfpl",), "OFL": (), "BSL": ("bsl", "mit"), "Artistic": ("gnu", "public")}
#: Every known sentence and every sentence that counts as unknown holds one of these.
HINTS = ("licen", "copyright", "warrant", "redistribution", "permission", "public domain", "rights reserved", "in no event", "general public", "fuck you want", "universal", "altered source", "origin of this", "attribution", "is provided", "advertising", "endorse", "cc0", "gpl", "obtain a copy")
#: A text without one of these holds no licence sentence but by chance.
STRONG = ("licen", "copyright", "permission is", "permission to use", "public domain", "rights reserved", "redistribution", "spdx", "public license", "cc0", "gpl")
UNKNOWN = re.compile(r"licensed under|under the (terms of )?(the )?\S+ license|license agreement")
LEADER = re.compile(r"^[\s]*(?:(?:/\*+|\*+/|\*+|//+!?|#+|;+|--+|%+|<!--+|\(\*|dnl\b|rem\b|>+|\|+)[ \t]*)+|(?:\*+/|--+>|\*+\))[\s]*$")
RULE_LINE = re.compile(r"[\W_]*")
CUT = re.compile(r"(?<=[.;:!?])\s+(?!either\b)")
SHORT = re.compile(r"\b([al]?gpl)[ -]?v?(?=\d)")
VERSION = re.compile(r"\bv(?:er(?:sion)?)?[. ]{0,2}(?=\d)")
PLAIN = re.compile(r"[a-z0-9][a-z0-9.+-]*")
LATER = re.compile(r"any later|or later|or newer|or above|\d\+|and later")
NUMBER = re.compile(r"version (\d(?:\.\d)?)")
KNOWN = tuple((name, re.compile(pattern)) for name, pattern in SENTENCES)
BY_LENGTH = tuple(sorted(RULES, key=lambda rule: -len(rule[1])))
CANONICAL = {x.lower(): x for x in SPDX}
ELEMENTS = {"attribution": "BY", "by": "BY", "noncommercial": "NC", "non": "", "commercial": "NC", "nc": "NC", "noderivatives": "ND", "noderivs": "ND", "nd": "ND", "sharealike": "SA", "sa": "SA"}


def paragraphs(text: str) -> list[str]:
    """The text's paragraphs in lower case, each of one line, without comment marks; SPDX lines stand alone."""
    out, held = [], []
    for line in text.split("\n"):
        line = LEADER.sub("", LEADER.sub("", line))
        tagged = "spdx-license-identifier:" in line
        if tagged or RULE_LINE.fullmatch(line):  # blank, or a rule of marks
            if held:
                out.append(" ".join(held))
            held = []
            if tagged:
                out.append("spdx-license-identifier " + line.split("spdx-license-identifier:", 1)[1])
        else:
            held.append(line)
    return [*out, " ".join(held)] if held else out


def normalised(sentence: str) -> str:
    """Plain words: letters, digits, inner dots and dashes."""
    text = SHORT.sub(r"\1 version ", sentence)
    text = VERSION.sub("version ", text.replace("licence", "license").replace("as-is", "as is").replace("and/or", "and or"))
    return " ".join(w.rstrip(".-") for w in PLAIN.findall(text))


def spdx_names(expression: str) -> list[str]:
    """Licences of an SPDX expression: the operands of AND and OR, each with its exception."""
    words = re.sub(r"[()]", " ", expression).split()
    out: list[str] = []
    joined = True  # the next word is an operand
    with_next = False
    for w in words:
        if w in ("and", "or"):
            joined = True
        elif w == "with" and out:
            with_next = True
        elif with_next:
            out[-1] += f" WITH {CANONICAL.get(w, w)}"
            with_next = False
        elif joined and re.fullmatch(r"[a-z0-9][a-z0-9.+-]*", w):
            base = w[:-1] if w.endswith("+") else w
            name = CANONICAL.get(base, base)
            out.append(f"{name}-or-later" if w.endswith("+") else name)
            joined = False
        else:
            break
    return out


def gnu_name(match: re.Match, text: str) -> str:
    """GPL, LGPL or AGPL with the version that the sentence names, and whether later ones do as well."""
    kind = (match["kind"] or match["short"] or "").strip()
    base = {"a": "AGPL", "affero": "AGPL", "l": "LGPL", "lesser": "LGPL", "library": "LGPL"}.get(kind, "GPL")
    version = NUMBER.search(text, match.start())
    if not version:
        return base
    number = version[1]
    return f"{base}-{number if '.' in number else number + '.0'}" + "-or-later" * bool(LATER.search(text, version.start()))


def named(identifier: str, match: re.Match, text: str) -> dict[str, str]:
    """What a sentence names: the version of a licence, or its name."""
    groups = match.groupdict()
    version, name = groups.get("version") or "", groups.get("name") or ""
    if identifier == "gnu-named":
        name = gnu_name(match, text)
    elif identifier == "mpl-notice":
        version = version or groups["other"]
    elif identifier == "bsd-named":
        name = name or groups["other"] or ("3" if re.search("new|modified", match[0]) else "2" if "simplified" in match[0] else "")
    elif "CC-" in identifier or identifier == "cc-named":
        name = "-".join(x for x in (ELEMENTS.get(w, "") for w in re.split("[ -]", name)) if x)
    return {"name": name, "version": version}


def identified(sentence: str) -> tuple[str, dict[str, str]] | None:
    """(identifier, what it names) of a known sentence; of an unknown one on licences UNKNOWN."""
    if sentence.startswith("spdx-license-identifier "):
        return "spdx", {"name": sentence.split(" ", 1)[1], "version": ""}
    text = normalised(sentence)
    for identifier, pattern in KNOWN:
        if m := pattern.search(text):
            return identifier, named(identifier, m, text)
    return ("unknown", {}) if UNKNOWN.search(text) else None


def filled(licence: str, found: list[tuple[str, dict[str, str]]]) -> str:
    values = {key: next((x[1][key] for x in found if x[1].get(key)), "") for key in ("name", "version")}
    name = re.sub("--+", "-", licence.format(**values)).strip("-")
    return "BSD" if name == "BSD-Clause" else name


def matched(found: list[tuple[str, dict[str, str]]]) -> list[str]:
    """Licences of an identifier sequence: at each place the longest rule that fits, else one step on.

    A copyright line belongs to what follows it; a known sentence that no rule takes up
    (one left over from a longer licence) names nothing. Behind a title, what its text holds is taken up.
    """
    found = [x for x in found if x[0] != "copyright"]
    out, at, taken = [], 0, None
    while at < len(found):
        identifier = found[at][0]
        if taken is not None and (identifier == "unknown" or identifier.startswith(taken)):
            at += 1
            continue
        if identifier.startswith("text:"):
            out.append(filled(identifier[5:], found[at : at + 1]))
            taken = TAKEN[out[-1].split("-")[0]]
            at += 1
            continue
        if identifier == "spdx":
            out.extend(spdx_names(found[at][1]["name"]))
            at += 1
            continue
        for licence, ids in BY_LENGTH:
            if tuple(x[0] for x in found[at : at + len(ids)]) == ids:
                out.append(filled(licence, found[at : at + len(ids)]))
                at += len(ids)
                break
        else:
            if identifier == "unknown":
                out.append("UNKNOWN")
            at += 1
    return out


def scan(text: str | None) -> tuple[list[str], int]:
    """(licences, sorted and distinct; sentences recognised)."""
    low = (text or "").lower()
    if not any(h in low for h in STRONG):
        return [], 0
    found = []
    for paragraph in paragraphs(low):
        if any(h in paragraph for h in HINTS):
            whole = [paragraph] if paragraph.startswith("spdx-license-identifier ") else CUT.split(VERSION.sub("version ", paragraph))
            found += [x for s in whole if any(h in s for h in HINTS) or "gpl" in s or " cc" in s if (x := identified(s))]
    names = set(matched(found))
    return sorted(names - {"all-rights-reserved"} or names), len(found)  # the reservation stands beside most licences


def _setup():
    def columns(texts: pa.Array) -> list[pa.Array]:
        found = [scan(x.as_py()) for x in texts]
        return [pa.array([x[0] for x in found], pa.list_(pa.string())), pa.array([x[1] for x in found], pa.int64())]

    return columns


def licences(df: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns, licences array<string> and n_sentences, one row a row.

    Null and empty texts, and texts without licence sentences: an empty array and 0. A
    licence named several times counts once; repeated rows get equal results. No shuffle.
    """
    fields = [T.StructField("licences", T.ArrayType(T.StringType())), T.StructField("n_sentences", T.LongType())]
    return with_text_columns(df, text_col, ["doc_id"] if keep is None else keep, fields, _setup)
