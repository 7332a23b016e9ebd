"""Licenses as a table of templates: short notices, headers, SPDX tags and whole texts.

A name is the license and the form: ``mit`` (a notice), ``mit header`` (an opening sentence or file header), ``mit tag``, ``mit text`` (the
whole license). ``licenses`` holds whole texts as published; the text of the AGPL is made from that of the GPL by the places in which they
differ. Licenses without a whole text here are known by their notices, tags and the sentences that name them.
"""

from __future__ import annotations

from pathlib import Path
from typing import NamedTuple


class Template(NamedTuple):
    """A text, the words that must be found of it whatever the coverage, and words that must not stand within what is found."""

    text: str
    required: str = ""
    without: str = ""


OTHER_GNU = "lesser library affero documentation"

#: license, name as it stands in a notice, words that tell it from others
NAMED = [
    ("0bsd", "BSD Zero Clause License", "bsd zero clause"),
    ("afl-3.0", "Academic Free License, Version 3.0", "academic free 3 0"),
    ("apache-1.1", "Apache Software License, Version 1.1", "apache 1 1"),
    ("artistic-1.0", "Artistic License 1.0", "artistic 1 0"),
    ("artistic-2.0", "Artistic License 2.0", "artistic 2 0"),
    ("bsd notice", "BSD License", "bsd license"),
    ("bsd-2-clause", "BSD 2-Clause License", "bsd 2 clause"),
    ("bsd-3-clause", "BSD 3-Clause License", "bsd 3 clause"),
    ("bsd-4-clause", "BSD 4-Clause License", "bsd 4 clause"),
    ("bsl-1.0", "Boost Software License, Version 1.0", "boost 1 0"),
    ("cc0-1.0", "CC0 1.0 Universal", "cc0 1 0"),
    ("cddl-1.0", "Common Development and Distribution License, Version 1.0", "common development distribution 1 0"),
    ("cddl-1.1", "Common Development and Distribution License, Version 1.1", "common development distribution 1 1"),
    ("ecl-2.0", "Educational Community License, Version 2.0", "educational community 2 0"),
    ("epl-1.0", "Eclipse Public License, Version 1.0", "eclipse 1 0"),
    ("epl-2.0", "Eclipse Public License, Version 2.0", "eclipse 2 0"),
    ("eupl-1.1", "European Union Public Licence, Version 1.1", "european union 1 1"),
    ("eupl-1.2", "European Union Public Licence, Version 1.2", "european union 1 2"),
    ("gfdl-1.1", "GNU Free Documentation License, Version 1.1", "free documentation 1 1"),
    ("gfdl-1.2", "GNU Free Documentation License, Version 1.2", "free documentation 1 2"),
    ("gfdl-1.3", "GNU Free Documentation License, Version 1.3", "free documentation 1 3"),
    ("isc", "ISC License", "isc license"),
    ("lppl-1.3c", "LaTeX Project Public License, Version 1.3c", "latex project 1 3c"),
    ("mit-0", "MIT No Attribution License", "mit no attribution"),
    ("mpl-1.0", "Mozilla Public License, Version 1.0", "mozilla 1 0"),
    ("mpl-1.1", "Mozilla Public License, Version 1.1", "mozilla 1 1"),
    ("mpl-2.0", "Mozilla Public License, Version 2.0", "mozilla 2 0"),
    ("ms-pl", "Microsoft Public License", "microsoft public license"),
    ("ms-rl", "Microsoft Reciprocal License", "microsoft reciprocal license"),
    ("ncsa", "University of Illinois/NCSA Open Source License", "illinois ncsa"),
    ("odbl-1.0", "Open Data Commons Open Database License v1.0", "open database v1 0"),
    ("odc-by-1.0", "Open Data Commons Attribution License v1.0", "data commons attribution v1 0"),
    ("ofl-1.1", "SIL Open Font License, Version 1.1", "open font 1 1"),
    ("osl-3.0", "Open Software License, Version 3.0", "open software 3 0"),
    ("pddl-1.0", "Open Data Commons Public Domain Dedication and License v1.0", "data commons public domain v1 0"),
    ("postgresql", "PostgreSQL License", "postgresql license"),
    ("python-2.0", "Python Software Foundation License, Version 2", "python foundation 2"),
    ("unicode-3.0", "Unicode License v3", "unicode license v3"),
    ("unlicense", "Unlicense", "unlicense"),
    ("wtfpl", "Do What The F*ck You Want To Public License", "do what want to public license"),
    ("x11", "X11 License", "x11 license"),
    ("zlib", "zlib License", "zlib license"),
]

#: opening sentences and file headers
HEADERS = {
    "apache-2.0 header": Template(
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache 2 0",
    ),
    "bsd": Template("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "cc0-1.0 header": Template("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived neighboring rights"),
    "cddl header": Template("The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")", "common development distribution"),
    "epl-1.0 header": Template("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "eclipse v1 0"),
    "epl-2.0 header": Template("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse 2 0"),
    "epl text opening": Template("The accompanying program is provided under the terms of this Eclipse Public License (\"Agreement\"). Any use, reproduction or distribution of the program constitutes recipient's acceptance of this agreement", "eclipse agreement"),
    "isc header": Template("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "fee provided"),
    "mit header": Template(
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction"
    ),
    "mpl-1.1 header": Template("The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License", "mozilla 1 1"),
    "mpl-2.0 header": Template("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2 0"),
    "unlicense header": Template("This is free and unencumbered software released into the public domain", "unencumbered public domain"),
    "wtfpl header": Template("This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The F*ck You Want To Public License", "do what want to"),
    "zlib header": Template(
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "alter redistribute freely",
    ),
    "rights reserved": Template("All rights reserved", "all rights reserved"),
}

TAGS = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC0-1.0
CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0
GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0
MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0 ODC-By-1.0 OFL-1.1 OSL-3.0 PDDL-1.0 PostgreSQL PSF-2.0 Python-2.0 Ruby Unicode-3.0 Unlicense Vim WTFPL X11 Zlib""".split()

CC_KINDS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_WORDS = {"by": "Attribution", "sa": "ShareAlike", "nc": "NonCommercial", "nd": "NoDerivatives"}


def _spaced(name: str) -> str:
    return name.lower().replace("-", " ").replace(".", " ")


def _creative_commons() -> dict[str, Template]:
    out = {}
    for kind in CC_KINDS:
        parts = kind.split("-")
        title = "-".join(CC_WORDS[p] for p in parts)
        others = [p for p in CC_WORDS if p not in parts]
        for version in CC_VERSIONS:
            name, number = f"cc-{kind}-{version}", version.replace(".", " ")
            out[name] = Template(f"Licensed under CC {kind.upper()} {version}", f"cc {_spaced(kind)} {number}", " ".join(others))
            without = " ".join(CC_WORDS[p].lower() for p in others)
            out[f"{name} header"] = Template(f"This work is licensed under a Creative Commons {title} {version} License", f"creative commons {_spaced(title)} {number}", without)
            out[f"{name} tag"] = Template(f"SPDX-License-Identifier: CC-{kind.upper()}-{version}", f"cc {_spaced(kind)} {number}", " ".join(others))
        out[f"cc-{kind}-4.0 text opening"] = Template(
            "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons "
            f"{title} 4.0 International Public License (\"Public License\")", f"creative commons {_spaced(title)} 4 0", without,
        )
    return out


def _gnu() -> dict[str, Template]:
    out = {}
    kinds = [("gpl", "", OTHER_GNU, ("1", "2", "3")), ("lgpl", "Library ", "", ("2",)), ("lgpl", "Lesser ", "", ("2.1", "3")), ("agpl", "Affero ", "", ("3",))]
    for name, word, without, versions in kinds:
        for version in versions:
            key = f"{name}-{version}" if "." in version else f"{name}-{version}.0"
            needed = _spaced(f"gnu {word}general public license {version}")
            out[key] = Template(f"This work is licensed under the GNU {word}General Public License, version {version}", needed, without)
            out[f"{key} terms"] = Template(f"Licensed under the GNU {word}General Public License, version {version}", needed, without)
            out[f"{key} notice"] = Template(f"Licensed under the {name.upper()}v{version}", _spaced(f"{name}v{version}"))
            out["gpl header" if key == "gpl-3.0" else f"{key} header"] = Template(
                f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {word}General Public License as published by "
                f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version", needed, without,
            )
    return out


def _affero(gpl: str) -> str:
    """The AGPL differs from version 3 of the GPL in its title, its preamble, its section 13 and its last notice."""
    cut = gpl.index("  13. Use with the GNU Affero"), gpl.index("  14. Revised Versions")
    section = """  13. Remote Network Interaction; Use with the GNU General Public License.

  Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users
interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding
Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary
means of facilitating copying of software.  This Corresponding Source shall include the Corresponding Source for any work covered by version 3
of the GNU General Public License that is incorporated pursuant to the following paragraph.

  Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3
of the GNU General Public License into a single combined work, and to convey the resulting work.  The terms of this License will continue to apply to
the part which is the covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public License.

"""
    kept = gpl[: cut[0]].replace("29 June 2007", "19 November 2007") + "\0" + gpl[cut[1] :]
    for name in ("GNU GENERAL", "GNU General"):
        kept = kept.replace(name, name.replace("GNU ", "GNU AFFERO " if name.isupper() else "GNU Affero "))
    return kept.replace("\0", section)


def _whole() -> dict[str, Template]:
    texts = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
    texts["agpl-3.0"] = _affero(texts["gpl-3.0"])
    required = {"bsd-3-clause": "endorse promote", "0bsd": "fee granted", "ncsa": "endorse promote", "isc": "provided appear copies"}
    without = {"cc-by-sa-4.0": "noncommercial noderivatives"}
    return {f"{name} text": Template(text, required.get(name, ""), without.get(name, "")) for name, text in texts.items()}


def templates() -> dict[str, Template]:
    out = {
        "apache-2.0": Template("Licensed under the Apache License, Version 2.0", "apache 2 0"),
        "mit": Template("Released under the MIT License", "mit license"),
    }
    out |= {name: Template(f"Licensed under the {title}", needed) for name, title, needed in NAMED}
    out |= {f"{tag.lower()} tag": Template(f"SPDX-License-Identifier: {tag}", _spaced(tag)) for tag in TAGS}
    return out | HEADERS | _creative_commons() | _gnu() | _whole()
