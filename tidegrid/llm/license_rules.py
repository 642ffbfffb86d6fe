"""Signature rules for license scans, written by hand.

One rule a line: label, priority, score, pattern. Patterns are regular expressions over a
text's lower-case words with one blank between them; a match covers whole words. They use
no anchors, look-around or unbounded repeats, so that a match spans few words.

Priority 3: notices and sentences of the license texts; 2: a name with its version;
1: a name alone; 0: hints that name no license.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# The phrases every scan reports, whatever else overlaps them.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

SIGNATURES = """
mit 3 1.0 permission is hereby granted free of charge to any person obtaining a copy
mit 3 0.9 the above copyright notice and this permission notice shall be included in all copies
mit 3 0.9 (?:released|licensed|distributed|available|published|provided) under the (?:terms of the )?mit license
mit 3 0.9 (?:use|uses|using) the mit license
mit 2 0.9 opensource org licenses? mit
mit 2 0.9 spdx license identifier mit
mit 1 0.8 (?:the )?mit license
mit 1 0.8 (?:the )?mit licence
mit 1 0.7 mit licensed
mit 1 0.7 license mit
mit 1 0.7 mit style license
mit-0 2 0.9 mit no attribution(?: license)?
mit-0 2 0.9 spdx license identifier mit 0
mit-0 1 0.8 mit 0 license
mit-modern 2 0.8 mit modern variant
x11 2 0.9 (?:the )?x11 license
x11 2 0.8 mit x11 license
x11 3 0.9 except as contained in this notice the name of the x consortium
expat 2 0.9 (?:the )?expat license
apache-2.0 3 1.0 (?:this work is )?licensed under the apache license version 2 0
apache-2.0 3 0.9 www apache org licenses license 2 0
apache-2.0 3 0.9 you may not use this file except in compliance with the license
apache-2.0 3 0.8 unless required by applicable law or agreed to in writing software
apache-2.0 2 0.9 apache license version 2(?: 0)?
apache-2.0 2 0.9 apache license 2 0
apache-2.0 2 0.9 apache 2 0(?: license)?
apache-2.0 2 0.9 apache software license (?:version )?2(?: 0)?
apache-2.0 2 0.9 spdx license identifier apache 2 0
apache-2.0 2 0.8 asl 2 0
apache-1.1 2 0.9 apache (?:software )?license (?:version )?1 1
apache-1.1 2 0.9 spdx license identifier apache 1 1
apache-1.0 2 0.9 apache (?:software )?license (?:version )?1 0
apache 1 0.7 (?:the )?apache license
apache 1 0.7 apache licen[cs]ed
apache 1 0.6 apache software foundation license
gpl-3.0 3 1.0 gnu general public license version 3
gpl-3.0 3 1.0 (?:this work is )?licensed under the gnu general public license version 3
gpl-3.0 3 0.9 gnu general public license as published by the free software foundation either version 3
gpl-3.0 2 0.9 gnu gpl (?:version |v)?3(?: 0)?
gpl-3.0 2 0.9 gpl (?:version )?3(?: 0)?
gpl-3.0 2 0.9 gplv3
gpl-3.0 2 0.9 gpl v3
gpl-3.0 2 0.9 www gnu org licenses gpl 3 0
gpl-3.0-only 2 1.0 spdx license identifier gpl 3 0 only
gpl-3.0-or-later 2 1.0 spdx license identifier gpl 3 0 or later
gpl-3.0-or-later 3 0.9 gnu general public license version 3 or (?:any )?later
gpl-2.0 3 1.0 gnu general public license version 2
gpl-2.0 3 0.9 gnu general public license as published by the free software foundation either version 2
gpl-2.0 2 0.9 gnu gpl (?:version |v)?2(?: 0)?
gpl-2.0 2 0.9 gpl (?:version )?2(?: 0)?
gpl-2.0 2 0.9 gplv2
gpl-2.0 2 0.9 gpl v2
gpl-2.0-only 2 1.0 spdx license identifier gpl 2 0 only
gpl-2.0-or-later 2 1.0 spdx license identifier gpl 2 0 or later
gpl-2.0-or-later 3 0.9 gnu general public license version 2 or (?:any )?later
gpl-1.0 2 0.8 gnu general public license version 1
gpl 1 0.8 gnu general public licen[cs]e
gpl 1 0.7 (?:the )?gnu gpl
gpl 1 0.6 general public license
gpl 3 0.8 this program is free software you can redistribute it and or modify it
gpl 3 0.7 without even the implied warranty of merchantability or fitness for a particular purpose see the gnu
gpl-classpath-exception 2 0.9 gpl with (?:the )?classpath exception
gpl-classpath-exception 2 0.9 gnu classpath exception
gpl-font-exception 2 0.9 gpl font exception
gpl-gcc-exception 2 0.9 gcc runtime library exception
lgpl-3.0 2 0.9 gnu lesser general public license version 3
lgpl-3.0 2 0.9 lgpl (?:version )?3(?: 0)?
lgpl-3.0 2 0.9 lgplv3
lgpl-3.0 2 1.0 spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.1 2 0.9 gnu lesser general public license version 2 1
lgpl-2.1 2 0.9 lgpl (?:version )?2 1
lgpl-2.1 2 0.9 lgplv2 1
lgpl-2.1 2 1.0 spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-2.0 2 0.9 gnu library general public license version 2
lgpl-2.0 2 0.8 lgpl (?:version )?2 0
lgpl 1 0.8 gnu (?:lesser|library) general public licen[cs]e
lgpl 1 0.7 (?:the )?lgpl
agpl-3.0 2 0.9 gnu affero general public license version 3
agpl-3.0 2 0.9 agpl (?:version )?3(?: 0)?
agpl-3.0 2 0.9 agplv3
agpl-3.0 2 1.0 spdx license identifier agpl 3 0(?: only| or later)?
agpl 1 0.8 (?:gnu )?affero general public licen[cs]e
agpl 1 0.7 (?:the )?agpl
agpl-1.0 2 0.8 affero general public license version 1
gfdl-1.3 2 0.9 gnu free documentation license version 1 3
gfdl-1.2 2 0.9 gnu free documentation license version 1 2
gfdl-1.1 2 0.9 gnu free documentation license version 1 1
gfdl 1 0.8 gnu free documentation licen[cs]e
gfdl 1 0.6 gfdl
bsd-2-clause 2 0.9 bsd 2 clause(?: license)?
bsd-2-clause 2 0.9 (?:2|two) clause bsd(?: license)?
bsd-2-clause 2 0.9 simplified bsd license
bsd-2-clause 2 0.9 freebsd license
bsd-2-clause 2 1.0 spdx license identifier bsd 2 clause
bsd-3-clause 2 0.9 bsd 3 clause(?: license)?
bsd-3-clause 2 0.9 (?:3|three) clause bsd(?: license)?
bsd-3-clause 2 0.9 (?:new|modified|revised) bsd license
bsd-3-clause 2 1.0 spdx license identifier bsd 3 clause
bsd-3-clause 3 0.9 nor the names? of (?:its|the) contributors may be used to endorse or promote
bsd-4-clause 2 0.9 bsd 4 clause(?: license)?
bsd-4-clause 2 0.9 (?:original|old) bsd license
bsd-4-clause 3 0.9 all advertising materials mentioning features or use of this software
bsd-0-clause 2 0.9 (?:zero|0) clause bsd(?: license)?
bsd-0-clause 2 0.9 0bsd
bsd 3 0.8 redistribution and use in source and binary forms with or without modification are permitted
bsd 3 0.7 redistributions of source code must retain the above copyright notice
bsd 3 0.7 redistributions in binary form must reproduce the above copyright notice
bsd 1 0.7 (?:the )?bsd licen[cs]e
bsd 1 0.6 bsd style licen[cs]e
bsd 1 0.6 bsd licensed
isc 2 0.9 (?:the )?isc license
isc 2 1.0 spdx license identifier isc
isc 3 0.9 permission to use copy modify and or distribute this software for any purpose
isc 3 0.8 permission to use copy modify and distribute this software for any purpose
mpl-2.0 3 1.0 this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 2 0.9 mozilla public license (?:version |v )?2(?: 0)?
mpl-2.0 2 0.9 mpl (?:version )?2 0
mpl-2.0 2 0.9 mozilla org mpl 2 0
mpl-1.1 2 0.9 mozilla public license (?:version |v )?1 1
mpl-1.1 2 0.9 mpl (?:version )?1 1
mpl-1.0 2 0.9 mozilla public license (?:version |v )?1 0
mpl 1 0.8 mozilla public licen[cs]e
epl-2.0 2 0.9 eclipse public license (?:version |v )?2(?: 0)?
epl-2.0 2 0.9 epl 2 0
epl-1.0 2 0.9 eclipse public license (?:version |v )?1(?: 0)?
epl-1.0 2 0.9 epl 1 0
epl 1 0.8 eclipse public licen[cs]e
edl-1.0 2 0.9 eclipse distribution license
cddl-1.1 2 0.9 common development and distribution license (?:version )?1 1
cddl-1.0 2 0.9 common development and distribution license(?: version| cddl)?(?: version)? 1 0
cddl 1 0.8 common development and distribution license
cpl-1.0 2 0.9 common public license (?:version )?1 0
cpl 1 0.7 common public license
ibm-pl 2 0.8 ibm public license
eupl-1.2 2 0.9 european union public licen[cs]e (?:version |v )?1 2
eupl-1.2 2 0.9 eupl (?:version )?1 2
eupl-1.1 2 0.9 european union public licen[cs]e (?:version |v )?1 1
eupl 1 0.8 european union public licen[cs]e
osl-3.0 2 0.9 open software license (?:version )?3 0
osl 1 0.7 open software license
afl-3.0 2 0.9 academic free license (?:version )?3 0
afl 1 0.7 academic free license
artistic-2.0 2 0.9 artistic license (?:version )?2 0
artistic-1.0 2 0.9 artistic license (?:version )?1 0
artistic 1 0.7 (?:perl )?artistic license
bsl-1.0 2 0.9 boost software license (?:version )?1 0
bsl-1.0 1 0.8 boost software license
zlib 2 0.9 zlib license
zlib 2 0.8 zlib libpng license
zlib 3 0.8 this notice may not be removed or altered from any source distribution
libpng 2 0.8 libpng license
python-2.0 2 0.9 python software foundation license(?: version 2)?
python-2.0 2 0.8 psf license
php-3.01 2 0.9 php license (?:version )?3 01
php 1 0.7 (?:the )?php license
ruby 2 0.8 (?:the )?ruby license
openssl 2 0.9 openssl license
openssl 3 0.9 software developed by the openssl project
postgresql 2 0.9 postgresql licen[cs]e
ncsa 2 0.9 university of illinois (?:ncsa )?open source license
ncsa 2 0.8 ncsa open source license
w3c 2 0.9 w3c software (?:notice and )?license
w3c 2 0.8 w3c document license
icu 2 0.8 (?:the )?icu license
unicode 2 0.8 unicode license agreement
curl 2 0.8 (?:the )?curl license
ijg 2 0.8 independent jpeg group license
freetype 2 0.8 freetype (?:project )?license
imagemagick 2 0.8 imagemagick license
qpl-1.0 2 0.8 q public license
sleepycat 2 0.8 sleepycat license
vim 2 0.8 vim license
zpl-2.1 2 0.8 zope public license
wtfpl 2 0.9 wtfpl
wtfpl 3 0.9 do what the fuck you want to public license
beerware 2 0.9 beerware license
beerware 2 0.9 beer ware license
jsonlicense 3 0.9 the software shall be used for good not evil
json 2 0.7 (?:the )?json license
ms-pl 2 0.9 microsoft public license
ms-rl 2 0.9 microsoft reciprocal license
ms-eula 2 0.7 microsoft software license terms
apsl-2.0 2 0.9 apple public source license
cecill-2.1 2 0.9 cecill (?:version )?2 1
cecill-b 2 0.9 cecill b license
cecill-c 2 0.9 cecill c license
cecill 1 0.7 cecill
mulan-psl-2 2 0.9 mulan psl v2
mulan-psl 1 0.8 mulan permissive software license
upl-1.0 2 0.9 universal permissive license
ofl-1.1 2 0.9 sil open font license(?: version 1 1)?
ofl 1 0.7 open font license
ufl 2 0.8 ubuntu font licen[cs]e
bitstream-vera 2 0.8 bitstream vera (?:fonts )?license
unlicense 2 0.9 (?:the )?unlicense
unlicense 3 1.0 this is free and unencumbered software released into the public domain
cc0-1.0 2 0.9 cc0(?: 1 0)?(?: universal)?
cc0-1.0 2 0.9 creative commons zero
cc0-1.0 3 0.9 waived all copyright and related or neighboring rights
public-domain 1 0.7 (?:released|dedicated|placed) (?:in|into|to) the public domain
public-domain 1 0.6 public domain dedication
public-domain 1 0.6 public domain mark
cc-by-4.0 2 0.9 cc by 4 0
cc-by-4.0 2 0.9 creative commons attribution 4 0
cc-by-4.0 2 0.9 creativecommons org licenses by 4 0
cc-by-3.0 2 0.9 cc by 3 0
cc-by-3.0 2 0.9 creative commons attribution 3 0
cc-by-3.0 2 0.9 creativecommons org licenses by 3 0
cc-by-2.0 2 0.9 cc by 2 0
cc-by-sa-4.0 2 0.9 cc by sa 4 0
cc-by-sa-4.0 2 0.9 creative commons attribution share ?alike 4 0
cc-by-sa-4.0 2 0.9 creativecommons org licenses by sa 4 0
cc-by-sa-3.0 2 0.9 cc by sa 3 0
cc-by-sa-3.0 2 0.9 creative commons attribution share ?alike 3 0
cc-by-sa-3.0 2 0.9 creativecommons org licenses by sa 3 0
cc-by-sa 1 0.8 cc by sa
cc-by-sa 1 0.8 creative commons attribution share ?alike
cc-by-nc-4.0 2 0.9 cc by nc 4 0
cc-by-nc-4.0 2 0.9 creative commons attribution non ?commercial 4 0
cc-by-nc-4.0 2 0.9 creativecommons org licenses by nc 4 0
cc-by-nc-3.0 2 0.9 cc by nc 3 0
cc-by-nc 1 0.8 creative commons attribution non ?commercial
cc-by-nc-sa-4.0 2 0.9 cc by nc sa 4 0
cc-by-nc-sa-4.0 2 0.9 creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0 2 0.9 cc by nc sa 3 0
cc-by-nc-sa 2 0.8 cc by nc sa
cc-by-nc-sa 2 0.8 creative commons attribution non ?commercial share ?alike
cc-by-nc-nd-4.0 2 0.9 cc by nc nd 4 0
cc-by-nc-nd-4.0 2 0.9 creativecommons org licenses by nc nd 4 0
cc-by-nc-nd 2 0.8 cc by nc nd
cc-by-nc-nd 2 0.8 creative commons attribution non ?commercial no ?deriv(?:atives|s)?
cc-by-nd-4.0 2 0.9 cc by nd 4 0
cc-by-nd 2 0.8 cc by nd
cc-by-nd 2 0.8 creative commons attribution no ?deriv(?:atives|s)?
cc-by 1 0.6 creative commons attribution
cc-by 1 0.6 creativecommons org licenses by
cc 0 0.5 creative commons licen[cs]e
odbl-1.0 2 0.9 open (?:data commons open )?database licen[cs]e
odc-by-1.0 2 0.9 open data commons attribution licen[cs]e
odc-pddl 2 0.9 public domain dedication and license
ogl-3.0 2 0.9 open government licen[cs]e (?:version |v)3(?: 0)?
ogl 1 0.8 open government licen[cs]e
cdla-permissive 2 0.9 community data license agreement permissive
cdla-sharing 2 0.9 community data license agreement sharing
etalab-2.0 2 0.8 licence ouverte open licence
dl-de-by-2.0 2 0.8 datenlizenz deutschland namensnennung
openrail-m 2 0.9 creativeml open rail m
openrail 1 0.8 open rail(?: m| s| d)? license
openrail 1 0.8 openrail
llama-community 2 0.9 llama (?:[234] )?community license
gemma 2 0.8 gemma terms of use
busl-1.1 2 0.9 business source license(?: 1 1)?
sspl-1.0 2 0.9 server side public license
elastic-2.0 2 0.9 elastic license (?:2 0|v2)
elastic 1 0.8 elastic license
commons-clause 2 0.9 commons clause(?: license condition)?
polyform-noncommercial 2 0.9 polyform noncommercial license
polyform-shield 2 0.9 polyform shield license
polyform 1 0.7 polyform
confluent-community 2 0.8 confluent community license
proprietary 3 0.8 unauthorized copying of this (?:file|software|document) (?:via any medium )?is strictly prohibited
proprietary 1 0.6 proprietary and confidential
proprietary 1 0.5 proprietary software license
proprietary 3 0.7 this software is the confidential and proprietary information
proprietary 3 0.7 no part of this publication may be reproduced
proprietary 1 0.6 for internal use only
proprietary 1 0.5 end user license agreement
all-rights-reserved 1 0.7 all rights reserved
all-rights-reserved 1 0.6 alle rechte vorbehalten
all-rights-reserved 1 0.6 tous droits réservés
all-rights-reserved 1 0.6 todos los derechos reservados
non-commercial 1 0.6 for non ?commercial (?:use|purposes) only
research-only 1 0.6 for research (?:use|purposes) only
some-rights-reserved 1 0.5 some rights reserved
unknown-license 0 0.3 (?:released|licensed|distributed|published) under (?:the|a)(?: terms of)?
unknown-license 0 0.3 this work is licensed under
unknown-license 0 0.2 see (?:the )?license (?:file )?for details
unknown-license 0 0.2 spdx license identifier
copyleft 0 0.2 copyleft license
permissive 0 0.2 permissive (?:free software )?license
"""

# Words too common to open the gate where a rarer one stands in the same pattern.
COMMON = frozenset(
    "the a an of and or in into to under this that is be by for see used use any all with as from without are"
    " software license licenses public version free open source general work mit name permission".split()
)


class Rule(NamedTuple):
    number: int
    label: str
    priority: int
    score: float
    keyword: str
    pattern: str
    base: bool


def keyword(pattern: str) -> str:
    """A word that every match of ``pattern`` holds: the longest plain one, rare ones first."""

    def without(group: re.Match) -> str:
        parts = group[1].split("|")
        apart = all(p.startswith(" ") for p in parts) or all(p.endswith(" ") for p in parts)
        return "" if group[2] and apart else "?"

    rest = re.sub(r"\(\?:([^()]*)\)(\??)", without, pattern.replace(" ?", "?"))
    words = [w for w in rest.split(" ") if re.fullmatch(r"[^\W_]+", w)]
    if not words:
        raise ValueError(f"no plain word in {pattern!r}")
    return max(words, key=lambda w: (w not in COMMON and not w.isdigit(), len(w)))


def as_regex(pattern: str) -> str:
    """``pattern`` over words that stand each between two blanks of its own."""
    return " " + pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + " "


def parse(text: str) -> list[Rule]:
    """The rules of a table like ``SIGNATURES``, after those for the base phrases."""
    rows = [(label, 3, 1.0, phrase, True) for label, phrase in BASE]
    for line in text.strip().splitlines():
        label, priority, score, pattern = line.split(" ", 3)
        rows.append((label, int(priority), float(score), pattern.strip(), False))
    return [
        Rule(i, label, priority, score, keyword(pattern), as_regex(pattern), base)
        for i, (label, priority, score, pattern, base) in enumerate(rows)
    ]


RULES = parse(SIGNATURES)
LEVELS = 4
