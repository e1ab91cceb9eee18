"""Ordered licence signatures: label, priority and pattern of each rule.

A pattern is a row of words as they stand after normalisation (lower case,
letters, digits and characters from U+0080 on). A word may be a regular
expression; one that ends in ``??`` may be absent. Rules of versioned families
are made from the family's pattern and its versions.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Names with a version or a text of their own; names of families; phrases that only say that a licence is there.
EXACT, FAMILY, GENERIC = 2, 1, 0
CONFIDENCE = {EXACT: 1.0, FAMILY: 0.8, GENERIC: 0.5}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str

    @property
    def regex(self) -> str:
        """The pattern over text in which each word has a space on both sides of its own."""
        out = ""
        for word in self.pattern.split(" "):
            out += f"(?: (?:{word[:-2]}) )?" if word.endswith("??") else f" (?:{word}) "
        return out


#: The fixed phrases and the labels they give.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Family: label, keyword, pattern of the name, versions.
VERSIONED = (
    ("gpl", "gnu", "gnu general public licen[cs]e", ("1", "2", "3")),
    ("gpl", "general", "general public licen[cs]e", ("1", "2", "3")),
    ("gpl", "gpl", "gpl", ("1", "2", "3")),
    ("lgpl", "lesser", "lesser general public licen[cs]e", ("2", "2 1", "3")),
    ("lgpl", "library", "library general public licen[cs]e", ("2", "2 1")),
    ("lgpl", "lgpl", "lgpl", ("2", "2 1", "3")),
    ("agpl", "affero", "affero general public licen[cs]e", ("1", "3")),
    ("agpl", "agpl", "agpl", ("1", "3")),
    ("gfdl", "documentation", "free documentation licen[cs]e", ("1 1", "1 2", "1 3")),
    ("gfdl", "gfdl", "gfdl", ("1 1", "1 2", "1 3")),
    ("apache", "apache", "apache software?? licen[cs]e", ("1 0", "1 1", "2")),
    ("apache", "apache", "apache", ("1 0", "1 1", "2")),
    ("mpl", "mozilla", "mozilla public licen[cs]e", ("1 0", "1 1", "2")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2")),
    ("epl", "eclipse", "eclipse public licen[cs]e", ("1", "2")),
    ("epl", "epl", "epl", ("1", "2")),
    ("edl", "eclipse", "eclipse distribution licen[cs]e", ("1",)),
    ("cddl", "distribution", "common development and distribution licen[cs]e", ("1 0", "1 1")),
    ("cddl", "cddl", "cddl", ("1 0", "1 1")),
    ("cpl", "common", "common public licen[cs]e", ("1",)),
    ("cpal", "attribution", "common public attribution licen[cs]e", ("1",)),
    ("ipl", "ibm", "ibm public licen[cs]e", ("1",)),
    ("eupl", "european", "european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("eupl", "eupl", "eupl", ("1 0", "1 1", "1 2")),
    ("osl", "open", "open software licen[cs]e", ("1", "2", "2 1", "3")),
    ("afl", "academic", "academic free licen[cs]e", ("1 1", "1 2", "2", "2 1", "3")),
    ("artistic", "artistic", "artistic licen[cs]e", ("1", "2")),
    ("php", "php", "php licen[cs]e", ("2 02", "3", "3 01")),
    ("psf", "python", "python software foundation licen[cs]e", ("2",)),
    ("bsl", "boost", "boost software licen[cs]e", ("1",)),
    ("ofl", "font", "open font licen[cs]e", ("1 0", "1 1")),
    ("ofl", "ofl", "ofl", ("1 0", "1 1")),
    ("odbl", "database", "open database licen[cs]e", ("1",)),
    ("busl", "business", "business source licen[cs]e", ("1 0", "1 1")),
    ("sspl", "server", "server side public licen[cs]e", ("1",)),
    ("elastic", "elastic", "elastic licen[cs]e", ("1", "2")),
    ("apsl", "apple", "apple public source licen[cs]e", ("1 0", "1 1", "1 2", "2")),
    ("npl", "netscape", "netscape public licen[cs]e", ("1 0", "1 1")),
    ("zpl", "zope", "zope public licen[cs]e", ("1 1", "2", "2 1")),
    ("ecl", "educational", "educational community licen[cs]e", ("1", "2")),
    ("lppl", "latex", "latex project public licen[cs]e", ("1 0", "1 1", "1 2", "1 3")),
    ("lppl", "lppl", "lppl", ("1 0", "1 1", "1 2", "1 3")),
    ("cecill", "cecill", "cecill", ("1", "1 1", "2", "2 1")),
    ("rpl", "reciprocal", "reciprocal public licen[cs]e", ("1 1", "1 5")),
    ("qpl", "public", "q public licen[cs]e", ("1",)),
    ("spl", "sun", "sun public licen[cs]e", ("1",)),
    ("upl", "universal", "universal permissive licen[cs]e", ("1",)),
    ("w3c", "w3c", "w3c software notice and licen[cs]e", ("1", "2")),
    ("openssl", "openssl", "openssl licen[cs]e", ("1", "3")),
    ("blueoak", "oak", "blue oak model licen[cs]e", ("1",)),
    ("polyform", "polyform", "polyform \\S+ licen[cs]e", ("1",)),
    ("mulan", "mulan", "mulan psl|permissive", ("1", "2")),
    ("cern-ohl", "cern", "cern open hardware licen[cs]e", ("1 1", "1 2", "2")),
    ("tapr-ohl", "tapr", "tapr open hardware licen[cs]e", ("1",)),
    ("motosoto", "motosoto", "motosoto open source licen[cs]e", ("0 9",)),
    ("ncgl", "government", "non commercial government licen[cs]e", ("1", "2")),
    ("ogl", "government", "open government licen[cs]e", ("1", "2", "3")),
)

#: Parts of the six shared licences: label, short words, long words.
SHARED = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share alike??"),
    ("cc-by-nd", "by nd", "attribution no derivatives|derivs"),
    ("cc-by-nc", "by nc", "attribution non?? commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non?? commercial share alike??"),
    ("cc-by-nc-nd", "by nc nd", "attribution non?? commercial no derivatives|derivs"),
)
SHARED_VERSIONS = ("1", "2", "2 5", "3", "4")

#: Rules written out: label, priority, keyword, pattern.
SINGLE = (
    ("mit", EXACT, "mit", "under the mit licen[cs]e"),
    ("mit", EXACT, "mit", "mit licen[cs]e"),
    ("mit", EXACT, "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit-0", EXACT, "mit", "mit no attribution"),
    ("mit-0", EXACT, "mit", "mit 0"),
    ("mit", FAMILY, "expat", "expat licen[cs]e"),
    ("x11", EXACT, "x11", "x11 licen[cs]e"),
    ("isc", EXACT, "isc", "isc licen[cs]e"),
    ("isc", EXACT, "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("0bsd", EXACT, "0bsd", "0bsd"),
    ("0bsd", EXACT, "bsd", "zero|0 clause bsd"),
    ("bsd-2-clause", EXACT, "bsd", "bsd 2|two clause"),
    ("bsd-2-clause", EXACT, "bsd", "2|two clause bsd"),
    ("bsd-2-clause", EXACT, "bsd", "simplified|freebsd bsd licen[cs]e"),
    ("bsd-3-clause", EXACT, "bsd", "bsd 3|three clause"),
    ("bsd-3-clause", EXACT, "bsd", "3|three clause bsd"),
    ("bsd-3-clause", EXACT, "bsd", "new|modified|revised bsd licen[cs]e"),
    ("bsd-4-clause", EXACT, "bsd", "bsd 4|four clause"),
    ("bsd-4-clause", EXACT, "bsd", "original bsd licen[cs]e"),
    ("bsd", FAMILY, "bsd", "bsd style?? licen[cs]ed?"),
    ("bsd", FAMILY, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", EXACT, "zlib", "zlib licen[cs]e"),
    ("zlib", EXACT, "warranty", "this software is provided as is without any express or implied warranty"),
    ("libpng", EXACT, "libpng", "libpng licen[cs]e"),
    ("unlicense", EXACT, "unlicense", "the?? unlicense"),
    ("unlicense", EXACT, "unencumbered", "free and unencumbered software released into the public domain"),
    ("wtfpl", EXACT, "wtfpl", "wtfpl"),
    ("wtfpl", EXACT, "public", "do what the \\S+ you want to public licen[cs]e"),
    ("cc0", EXACT, "cc0", "cc0"),
    ("cc0", EXACT, "zero", "creative commons zero"),
    ("public-domain", EXACT, "domain", "in|into|to the public domain"),
    ("public-domain", FAMILY, "domain", "public domain"),
    ("pddl", EXACT, "pddl", "pddl"),
    ("pddl", EXACT, "dedication", "public domain dedication and licen[cs]e"),
    ("odc-by", EXACT, "odc", "odc by"),
    ("odc-by", EXACT, "commons", "open data commons attribution licen[cs]e"),
    ("ms-pl", EXACT, "microsoft", "microsoft public licen[cs]e"),
    ("ms-pl", EXACT, "ms", "ms pl"),
    ("ms-rl", EXACT, "microsoft", "microsoft reciprocal licen[cs]e"),
    ("ms-rl", EXACT, "ms", "ms rl"),
    ("json", EXACT, "evil", "shall be used for good not evil"),
    ("ruby", EXACT, "ruby", "ruby licen[cs]e"),
    ("perl", EXACT, "perl", "same terms as perl itself"),
    ("vim", EXACT, "vim", "vim licen[cs]e"),
    ("sleepycat", EXACT, "sleepycat", "sleepycat licen[cs]e"),
    ("ncsa", EXACT, "ncsa", "ncsa open source licen[cs]e"),
    ("postgresql", EXACT, "postgresql", "postgresql licen[cs]e"),
    ("curl", EXACT, "curl", "curl licen[cs]e"),
    ("freetype", EXACT, "freetype", "freetype project?? licen[cs]e"),
    ("icu", EXACT, "icu", "icu licen[cs]e"),
    ("unicode", EXACT, "unicode", "unicode licen[cs]e|terms"),
    ("wxwindows", EXACT, "wxwindows", "wxwindows library?? licen[cs]e"),
    ("nasa", EXACT, "nasa", "nasa open source agreement"),
    ("beerware", EXACT, "beerware", "beerware|beer licen[cs]e"),
    ("hpnd", EXACT, "hpnd", "hpnd"),
    ("hpnd", EXACT, "permission", "historical permission notice and disclaimer"),
    ("cube", EXACT, "cube", "cube licen[cs]e"),
    ("intel", EXACT, "intel", "intel open source licen[cs]e"),
    ("nokia", EXACT, "nokia", "nokia open source licen[cs]e"),
    ("watcom", EXACT, "sybase", "sybase open watcom public licen[cs]e"),
    ("tcl", EXACT, "tcl", "tcl tk?? licen[cs]e"),
    ("ijg", EXACT, "jpeg", "independent jpeg group licen[cs]e"),
    ("imagemagick", EXACT, "imagemagick", "imagemagick licen[cs]e"),
    ("info-zip", EXACT, "zip", "info zip licen[cs]e"),
    ("llvm-exception", EXACT, "llvm", "llvm exceptions?"),
    ("classpath-exception", EXACT, "classpath", "classpath exceptions?"),
    ("apache", FAMILY, "apache", "apache software?? licen[cs]ed?"),
    ("gpl", FAMILY, "gnu", "gnu general public licen[cs]e"),
    ("gpl", FAMILY, "gpl", "gpl"),
    ("lgpl", FAMILY, "lgpl", "lgpl"),
    ("lgpl", FAMILY, "lesser", "lesser general public licen[cs]e"),
    ("agpl", FAMILY, "agpl", "agpl"),
    ("agpl", FAMILY, "affero", "affero general public licen[cs]e"),
    ("mpl", FAMILY, "mozilla", "mozilla public licen[cs]e"),
    ("epl", FAMILY, "eclipse", "eclipse public licen[cs]e"),
    ("creative-commons", FAMILY, "creative", "creative commons licen[cs]ed?"),
    ("copyleft", FAMILY, "copyleft", "copyleft"),
    ("proprietary", EXACT, "proprietary", "proprietary and confidential"),
    ("proprietary", FAMILY, "reserved", "all rights reserved"),
    ("copyright", GENERIC, "copyright", "copyright c?? \\d{4}"),
    ("copyright", GENERIC, "copyright", "copyright notice|holders?|owners?"),
    ("unknown-license", GENERIC, "licensed", "licensed under \\S+ \\S+?? \\S+?? \\S+?? \\S+??"),
    ("unknown-license", GENERIC, "released", "released under \\S+ \\S+?? \\S+?? licen[cs]e"),
    ("unknown-license", GENERIC, "distributed", "distributed under \\S+ \\S+?? \\S+?? licen[cs]e"),
    ("unknown-license", GENERIC, "terms", "under the terms of \\S+ \\S+?? \\S+?? licen[cs]e"),
    ("unknown-license", GENERIC, "license", "see the?? license file|for"),
)


def _versioned() -> list[Rule]:
    out = []
    for stem, keyword, name, versions in VERSIONED:
        for v in versions:
            label = f"{stem}-{v.replace(' ', '.')}"
            out.append(Rule(label, EXACT, keyword, f"{name} version|v?? {v}"))
            if " " not in name and " " not in v:
                out += [Rule(label, EXACT, f"{name}{glue}{v}", f"{name}{glue}{v}") for glue in ("", "v")]
                out.append(Rule(label, EXACT, keyword, f"{name} v{v}"))
            if stem in ("gpl", "lgpl", "agpl"):
                out.append(Rule(f"{label}-or-later", EXACT, keyword, f"{name} version|v?? {v} or at?? your?? option?? any?? later"))
    return out


def _shared() -> list[Rule]:
    out = []
    for label, short, long in SHARED:
        out.append(Rule(label, FAMILY, "cc", f"cc {short}"))
        out.append(Rule(label, FAMILY, "creative", f"creative commons {long}"))
        for v in SHARED_VERSIONS:
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", EXACT, "cc", f"cc {short} {v}"))
            out.append(Rule(f"{label}-{v.replace(' ', '.')}", EXACT, "creative", f"creative commons {long} international?? licen[cs]e?? {v}"))
    return out


def rules() -> list[Rule]:
    """All rules, those of higher priority first, in the order of the tables."""
    made = [Rule(*x) for x in SINGLE] + _versioned() + _shared() + [Rule(label, EXACT, phrase.split()[2 if label == "mit" else 0], phrase) for phrase, label in BASE]
    return sorted(dict.fromkeys(made), key=lambda r: -r.priority)
