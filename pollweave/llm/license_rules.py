"""Signature rules for licenses, as text in natural order.

Patterns match normalised text: lower-case words, one space between them, so "2.0" reads
"2 0". A rule is looked at only in texts that hold its keyword.
"""

from __future__ import annotations

# Kinds of rules: (priority, score). A lower priority number is stronger.
KINDS = {
    "identifier": (1, 1.0),
    "notice": (1, 0.95),
    "grant": (2, 0.9),
    "link": (2, 0.8),
    "title": (3, 0.7),
    "mention": (4, 0.5),
    "base": (4, 0.5),
}

BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

# Fragments of words that open a text to rules. Every match of a rule holds its keyword or
# one of that keyword's other fragments.
KEYWORDS = [
    "licen", "spdx", "copyright", "creativecommons", "gnu", "bsd", "apache", "mozilla",
    "warrant", "permission", "redistribut", "public", "copyleft", "eclipse", "opensource",
    "gpl", "mpl", "cc0", "cc", "rail", "attribution", "ofl", "wtfpl", "bsl11", "eupl",
    "advertising", "applicable", "contributors",
]
ALSO = {
    "gpl": ["public"], "mpl": ["mozilla"], "cc0": ["commons"], "cc": ["commons"],
    "bsd": ["berkeley"],
}
# Fragments that count as a whole word only.
WHOLE = ["cc"]
# Keywords of names that are a title only with a license word near them.
SHORT = ["gpl", "mpl", "cc0", "cc", "rail", "attribution"]

_V = r"(?: version| ver| v)?"
_CC = r"(?:creative commons|cc) "

# label: (pattern of the name, its keyword, SPDX identifiers as words, words of its address)
NAMES = {
    "mit": (r"mit license", "licen", "mit", r"opensource org licenses mit"),
    "mit-0": (r"mit no attribution(?: license)?", "attribution", "mit 0",
              r"opensource org licenses mit 0"),
    "x11": (r"x11 license", "licen", "x11", None),
    "isc": (r"isc license", "licen", "isc", r"opensource org licenses isc"),
    "0bsd": (r"(?:zero clause bsd|bsd zero clause)(?: license)?", "bsd", "0bsd",
             r"opensource org licenses 0bsd"),
    "bsd-2-clause": (r"(?:2 clause|simplified|freebsd) bsd(?: license)?|bsd 2 clause(?: license)?",
                     "bsd", "bsd 2 clause", r"opensource org licenses bsd 2 clause"),
    "bsd-3-clause": (r"(?:3 clause|new|revised|modified) bsd(?: license)?|bsd 3 clause(?: license)?",
                     "bsd", "bsd 3 clause", r"opensource org licenses bsd 3 clause"),
    "bsd-4-clause": (r"(?:4 clause|original|old) bsd(?: license)?|bsd 4 clause(?: license)?",
                     "bsd", "bsd 4 clause", None),
    "apache-1.1": (rf"apache(?: software)? license{_V} 1 1", "apache", "apache 1 1",
                   r"apache org licenses license 1 1"),
    "apache-2.0": (rf"apache(?: software)? license{_V} 2(?: 0)?|apache 2(?: 0)?(?: license)?",
                   "apache", "apache 2 0", r"apache org licenses license 2 0"),
    "gpl-1.0": (rf"(?:gnu )?(?:general public license|gpl){_V} 1(?: 0)?", "gpl",
                "gpl 1 0(?: only| or later)?", r"gnu org licenses old licenses gpl 1 0"),
    "gpl-2.0": (rf"(?:gnu )?(?:general public license|gpl){_V} 2(?: 0)?", "gpl",
                "gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    "gpl-3.0": (rf"(?:gnu )?(?:general public license|gpl){_V} 3(?: 0)?", "gpl",
                "gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0"),
    "lgpl-2.0": (rf"(?:gnu )?(?:library general public license|lgpl){_V} 2(?: 0)?", "gpl",
                 "lgpl 2 0(?: only| or later)?", r"gnu org licenses old licenses lgpl 2 0"),
    "lgpl-2.1": (rf"(?:gnu )?(?:lesser general public license|lgpl){_V} 2 1", "gpl",
                 "lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    "lgpl-3.0": (rf"(?:gnu )?(?:lesser general public license|lgpl){_V} 3(?: 0)?", "gpl",
                 "lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    "agpl-3.0": (rf"(?:gnu )?(?:affero general public license|agpl){_V} 3(?: 0)?", "gpl",
                 "agpl 3 0(?: only| or later)?", r"gnu org licenses agpl 3 0"),
    "gfdl-1.3": (rf"(?:gnu )?free documentation license(?:{_V} 1 [123])?", "licen",
                 "gfdl 1 3(?: only| or later)?", r"gnu org licenses fdl(?: 1 3)?"),
    "mpl-1.1": (rf"(?:mozilla public license|mpl){_V} 1 1", "mpl", "mpl 1 1", r"mozilla org mpl 1 1"),
    "mpl-2.0": (rf"(?:mozilla public license|mpl){_V} 2(?: 0)?", "mpl", "mpl 2 0",
                r"mozilla org mpl 2 0"),
    "epl-1.0": (rf"eclipse public license{_V} 1(?: 0)?", "eclipse", "epl 1 0",
                r"eclipse org legal epl v10"),
    "epl-2.0": (rf"eclipse public license{_V} 2(?: 0)?", "eclipse", "epl 2 0",
                r"eclipse org legal epl (?:2 0|v20)"),
    "edl-1.0": (r"eclipse distribution license(?: 1 0)?", "eclipse", None,
                r"eclipse org org documents edl v10"),
    "cddl-1.0": (rf"common development and distribution license(?:{_V} 1(?: 0)?)?", "licen",
                 "cddl 1 0", r"opensource org licenses cddl 1 0"),
    "cpl-1.0": (rf"common public license(?:{_V} 1(?: 0)?)?", "licen", "cpl 1 0",
                r"opensource org licenses cpl1 0"),
    "eupl-1.2": (rf"european union public licen[cs]e(?:{_V} 1 2)?", "licen", "eupl 1 2",
                 r"joinup ec europa eu collection eupl"),
    "artistic-1.0": (r"artistic license(?: 1 0)?", "licen", "artistic 1 0",
                     r"opensource org licenses artistic license 1 0"),
    "artistic-2.0": (r"artistic license 2 0", "licen", "artistic 2 0",
                     r"opensource org licenses artistic license 2 0"),
    "bsl-1.0": (r"boost software license(?:(?: version)? 1 0)?", "licen", "bsl 1 0",
                r"boost org license 1 0"),
    "busl-1.1": (r"business source license(?: 1 1)?", "licen", "busl 1 1", r"mariadb com bsl11"),
    "sspl-1.0": (r"server side public license(?:(?: version)? 1)?", "licen", "sspl 1 0",
                 r"mongodb com licensing server side public license"),
    "elastic-2.0": (r"elastic license(?: 2 0)?", "licen", "elastic 2 0",
                    r"elastic co licensing elastic license"),
    "zlib": (r"zlib(?: libpng)? license", "licen", "zlib", r"opensource org licenses zlib"),
    "libpng-2.0": (r"png reference library license(?: version 2)?", "licen", "libpng 2 0", None),
    "openssl": (r"openssl license", "licen", "openssl", r"openssl org source license"),
    "psf-2.0": (r"python software foundation license(?: version 2)?", "licen", "psf 2 0",
                r"docs python org 3 license"),
    "php-3.01": (r"php license(?: version)? 3 01", "licen", "php 3 01", r"php net license 3 01"),
    "ruby": (r"ruby license", "licen", "ruby", None),
    "postgresql": (r"postgresql license", "licen", "postgresql", r"postgresql org about licence"),
    "ncsa": (r"university of illinois ncsa open source license", "licen", "ncsa",
             r"opensource org licenses ncsa"),
    "unlicense": (r"(?:the )?unlicense", "licen", "unlicense", r"unlicense org"),
    "wtfpl": (r"do what the fuck you want to public license", "licen", "wtfpl", r"wtfpl net"),
    "ms-pl": (r"microsoft public license", "licen", "ms pl", r"opensource org licenses ms pl"),
    "ms-rl": (r"microsoft reciprocal license", "licen", "ms rl", r"opensource org licenses ms rl"),
    "ofl-1.1": (r"sil open font license(?:(?: version)? 1 1)?", "licen", "ofl 1 1",
                r"scripts sil org ofl"),
    "odbl-1.0": (r"open database licen[cs]e(?: v?1 0)?", "licen", "odbl 1 0",
                 r"opendatacommons org licenses odbl"),
    "odc-by-1.0": (r"open data commons attribution licen[cs]e(?: v?1 0)?", "licen", "odc by 1 0",
                   r"opendatacommons org licenses by"),
    "pddl-1.0": (r"public domain dedication and licen[cs]e(?: v?1 0)?", "licen", "pddl 1 0",
                 r"opendatacommons org licenses pddl"),
    "cc0-1.0": (r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?|creative commons zero", "cc0",
                "cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    "cc-by-3.0": (rf"{_CC}(?:by|attribution) 3 0", "cc", "cc by 3 0",
                  r"creativecommons org licenses by 3 0"),
    "cc-by-4.0": (rf"{_CC}(?:by|attribution) 4 0", "cc", "cc by 4 0",
                  r"creativecommons org licenses by 4 0"),
    "cc-by-sa-3.0": (rf"{_CC}(?:by sa|attribution share ?alike) 3 0", "cc", "cc by sa 3 0",
                     r"creativecommons org licenses by sa 3 0"),
    "cc-by-sa-4.0": (rf"{_CC}(?:by sa|attribution share ?alike) 4 0", "cc", "cc by sa 4 0",
                     r"creativecommons org licenses by sa 4 0"),
    "cc-by-nd-4.0": (rf"{_CC}(?:by nd|attribution no ?deriv(?:ative)?s) 4 0", "cc", "cc by nd 4 0",
                     r"creativecommons org licenses by nd 4 0"),
    "cc-by-nc-3.0": (rf"{_CC}(?:by nc|attribution non ?commercial) 3 0", "cc", "cc by nc 3 0",
                     r"creativecommons org licenses by nc 3 0"),
    "cc-by-nc-4.0": (rf"{_CC}(?:by nc|attribution non ?commercial) 4 0", "cc", "cc by nc 4 0",
                     r"creativecommons org licenses by nc 4 0"),
    "cc-by-nc-sa-4.0": (rf"{_CC}(?:by nc sa|attribution non ?commercial share ?alike) 4 0", "cc",
                        "cc by nc sa 4 0", r"creativecommons org licenses by nc sa 4 0"),
    "cc-by-nc-nd-4.0": (rf"{_CC}(?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s) 4 0",
                        "cc", "cc by nc nd 4 0", r"creativecommons org licenses by nc nd 4 0"),
    "openrail-m": (r"(?:bigscience |creativeml )?open ?rail m(?: license)?", "rail",
                   "openrail m", None),
}

# (label, keyword, pattern): sentences of notices and family names without a version.
NOTICES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining"
     r" a copy(?: of this software)?"),
    ("mit", "permission", r"the above copyright notice and this permission notice shall be included"
     r" in all copies"),
    ("mit", "warrant", r"the software is provided as is without warranty of any kind"
     r" express or implied"),
    ("isc", "permission", r"permission to use copy modify and(?: or)? distribute this software"
     r" for any purpose with or without fee is hereby granted"),
    ("bsd-3-clause", "contributors", r"neither the name of (?:\S+ ){1,12}nor the names of its"
     r" contributors may be used"),
    ("bsd-2-clause", "redistribut", r"redistribution and use in source and binary forms with or"
     r" without modification are permitted"),
    ("bsd-2-clause", "redistribut", r"redistributions of source code must retain the above"
     r" copyright notice"),
    ("bsd-2-clause", "redistribut", r"redistributions in binary form must reproduce the above"
     r" copyright notice"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this"
     r" software must display"),
    ("apache-2.0", "licen", r"licensed under the apache license version 2 0"),
    ("apache-2.0", "licen", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing"
     r" software"),
    ("apache-2.0", "licen", r"licensed to the apache software foundation asf"),
    ("gpl-2.0", "gnu", r"gnu general public license as published by the free software foundation"
     r" either version 2"),
    ("gpl-3.0", "gnu", r"gnu general public license as published by the free software foundation"
     r" either version 3"),
    ("lgpl-2.1", "gnu", r"gnu lesser general public license as published by the free software"
     r" foundation either version 2 1"),
    ("lgpl-3.0", "gnu", r"gnu lesser general public license as published by the free software"
     r" foundation either version 3"),
    ("agpl-3.0", "gnu", r"gnu affero general public license as published by the free software"
     r" foundation either version 3"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public"
     r" license v 2 0"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license"
     r" version 1 1"),
    ("epl-2.0", "eclipse", r"made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", "eclipse", r"made available under the terms of the eclipse public license v1 0"),
    ("cddl-1.0", "licen", r"subject to the terms of the common development and distribution license"),
    ("bsl-1.0", "licen", r"distributed under the boost software license version 1 0"),
    ("zlib", "warrant", r"this software is provided as is without any express or implied warranty"),
    ("unlicense", "public", r"this is free and unencumbered software released into the public"
     r" domain"),
    ("cc0-1.0", "copyright", r"has waived all copyright and related or neighboring rights"),
    ("public-domain", "public", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", "public", r"this (?:work|file|code|text) is in the public domain"),
    ("proprietary", "copyright", r"copyright (?:\S+ ){1,8}all rights reserved"),
    ("proprietary", "permission", r"may not be (?:reproduced|copied|distributed)(?: \S+){0,6}"
     r" without (?:prior |express |written )*permission"),
    ("proprietary", "licen", r"end user license agreement"),
    ("proprietary", "licen", r"proprietary license"),
    ("commercial", "licen", r"commercial license"),
    ("copyleft", "copyleft", r"copyleft"),
]

MENTIONS = [
    ("bsd", "bsd", r"bsd license|berkeley software distribution"),
    ("gpl", "gnu", r"gnu gpl"),
    ("lgpl", "licen", r"(?:lesser|library) general public license"),
    ("agpl", "licen", r"affero general public license"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl", "eclipse", r"eclipse public license"),
    ("apache", "apache", r"apache software license"),
    ("creative-commons", "licen", r"creative commons licen[cs]e"),
    ("osi", "opensource", r"opensource org licenses"),
]

_GRANT = (
    r"(?:licensed|released|distributed|available|published|covered) (?:under|by|with)"
    r"(?: the)?(?: terms of)?(?: the)? "
)


# A match begins behind a space and ends before one.
BEFORE, AFTER = "(?<= )", "(?= )"


def rules() -> list[dict]:
    """All rules in order: id, label, kind, priority, score, keyword and pattern."""
    found = [("base", label, "licen", phrase) for label, phrase in BASE.items()]
    for label, (name, keyword, spdx, link) in NAMES.items():
        if spdx:
            found.append(("identifier", label, "spdx", rf"spdx license identifier {spdx}"))
            found.append(("identifier", label, "licen", rf"license (?:id|expression) {spdx}"))
        found.append(("grant", label, keyword, rf"{_GRANT}(?:{name})"))
        if link:
            opener = max((k for k in KEYWORDS if k in link and k not in WHOLE), key=len)
            found.append(("link", label, opener, rf"(?:https? )?(?:www )?{link}"))
        if keyword not in SHORT:
            found.append(("title", label, keyword, name))
        else:
            found.append(("title", label, "licen", rf"(?:{name})(?= (?:\S+ ){{0,8}}licen[cs]e)"))
            found.append(("title", label, "licen", rf"licen[cs]e[sd]? (?:\S+ ){{0,4}}(?:{name})"))
    found += [("notice", label, keyword, pattern) for label, keyword, pattern in NOTICES]
    found += [("mention", label, keyword, pattern) for label, keyword, pattern in MENTIONS]
    return [
        {
            "id": number, "label": label, "kind": kind, "priority": KINDS[kind][0],
            "score": KINDS[kind][1], "keyword": keyword,
            "pattern": rf"{BEFORE}(?:{pattern}){AFTER}",
        }
        for number, (kind, label, keyword, pattern) in enumerate(found)
    ]
