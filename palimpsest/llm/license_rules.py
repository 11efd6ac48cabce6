"""Signature rules for licence notices, in order.

A line is ``label | priority | keywords | pattern``. Every keyword is a substring
of any lower-cased text that the pattern matches. In a pattern a space
stands for any run of characters that belong to no word, and the whole has to
begin and end at word edges; the rest is a regular expression over words of
letters and digits. ``{a;b}`` in label and pattern makes a rule for each.

Priorities: 1 a machine-readable tag or a sentence of the licence itself, 2 a
name with its version, 3 a name without, 4 a bare mention.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TEXT = r"""
{gpl-1.0;gpl-2.0;gpl-3.0} | 1 | spdx | spdx licen[sc]e identifier gpl {1;2;3} 0( only| or later)?
{lgpl-2.0;lgpl-2.1;lgpl-3.0} | 1 | spdx | spdx licen[sc]e identifier lgpl {2 0;2 1;3 0}( only| or later)?
{agpl-1.0;agpl-3.0} | 1 | spdx | spdx licen[sc]e identifier agpl {1;3} 0( only| or later)?
{apache-1.0;apache-1.1;apache-2.0} | 1 | spdx | spdx licen[sc]e identifier apache {1 0;1 1;2 0}
{bsd-2-clause;bsd-3-clause;bsd-4-clause} | 1 | spdx | spdx licen[sc]e identifier bsd {2;3;4} clause
bsd-0-clause | 1 | spdx | spdx licen[sc]e identifier 0bsd
mit | 1 | spdx | spdx licen[sc]e identifier mit
mit-0 | 1 | spdx | spdx licen[sc]e identifier mit 0
isc | 1 | spdx | spdx licen[sc]e identifier isc
zlib | 1 | spdx | spdx licen[sc]e identifier zlib
unlicense | 1 | spdx | spdx licen[sc]e identifier unlicen[sc]e
wtfpl | 1 | spdx | spdx licen[sc]e identifier wtfpl
{mpl-1.0;mpl-1.1;mpl-2.0} | 1 | spdx | spdx licen[sc]e identifier mpl {1 0;1 1;2 0}
{epl-1.0;epl-2.0} | 1 | spdx | spdx licen[sc]e identifier epl {1;2} 0
{cddl-1.0;cddl-1.1} | 1 | spdx | spdx licen[sc]e identifier cddl 1 {0;1}
{eupl-1.0;eupl-1.1;eupl-1.2} | 1 | spdx | spdx licen[sc]e identifier eupl 1 {0;1;2}
{cc-by-1.0;cc-by-2.0;cc-by-2.5;cc-by-3.0;cc-by-4.0} | 1 | spdx | spdx licen[sc]e identifier cc by {1 0;2 0;2 5;3 0;4 0}
{cc-by-sa-1.0;cc-by-sa-2.0;cc-by-sa-2.5;cc-by-sa-3.0;cc-by-sa-4.0} | 1 | spdx | spdx licen[sc]e identifier cc by sa {1 0;2 0;2 5;3 0;4 0}
cc0-1.0 | 1 | spdx | spdx licen[sc]e identifier cc0 1 0
{bsl-1.0;bsl-1.1} | 1 | spdx | spdx licen[sc]e identifier (bsl|busl) {1 0;1 1}
{artistic-1.0;artistic-2.0} | 1 | spdx | spdx licen[sc]e identifier artistic {1;2} 0
{ofl-1.0;ofl-1.1} | 1 | spdx | spdx licen[sc]e identifier ofl 1 {0;1}
{ecl-1.0;ecl-2.0} | 1 | spdx | spdx licen[sc]e identifier ecl {1;2} 0
{afl-2.1;afl-3.0} | 1 | spdx | spdx licen[sc]e identifier afl {2 1;3 0}
{osl-2.1;osl-3.0} | 1 | spdx | spdx licen[sc]e identifier osl {2 1;3 0}
postgresql | 1 | spdx | spdx licen[sc]e identifier postgresql
python-2.0 | 1 | spdx | spdx licen[sc]e identifier python 2 0
{php-3.0;php-3.01} | 1 | spdx | spdx licen[sc]e identifier php {3 0;3 01}
ncsa | 1 | spdx | spdx licen[sc]e identifier ncsa
vim | 1 | spdx | spdx licen[sc]e identifier vim
gpl | 1 | redistribute gnu | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
lgpl | 1 | redistribute gnu | this (library|program) is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public licen[sc]e
agpl | 1 | redistribute gnu | this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e
gpl | 1 | merchantability fitness | without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
gpl | 1 | licen gnu | you should have received a copy of the gnu general public licen[sc]e along with this program
lgpl | 1 | licen gnu | you should have received a copy of the gnu (lesser|library) general public licen[sc]e along with this (library|program)
agpl | 1 | licen gnu | you should have received a copy of the gnu affero general public licen[sc]e along with this program
{gpl-2.0-or-later;gpl-3.0-or-later} | 1 | licen gnu | gnu general public licen[sc]e as published by the free software foundation either version {2;3} of the licen[sc]e or at your option any later version
{lgpl-2.1-or-later;lgpl-3.0-or-later} | 1 | licen gnu | gnu lesser general public licen[sc]e as published by the free software foundation either version {2 1;3} of the licen[sc]e or at your option any later version
mit | 1 | granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 1 | merchantability | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | 1 | substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | 1 | granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd | 1 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3-clause | 1 | contributors promote | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | 1 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledg(e)?ment
bsd | 1 | contributors warrant | this software is provided by the copyright holders and contributors as is and any express or implied warranties
apache-2.0 | 1 | apache | licensed under the apache licen[sc]e version 2 0
apache-2.0 | 1 | compliance licen | you may not use this file except in compliance with the licen[sc]e
apache-2.0 | 1 | limitations licen | see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e
apache-1.1 | 1 | apache | this product includes software developed by the apache software foundation
{mpl-1.1;mpl-2.0} | 1 | mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e v(ersion)? {1 1;2 0}
mpl | 1 | mozilla | the contents of this file are subject to the mozilla public licen[sc]e
{epl-1.0;epl-2.0} | 1 | eclipse | made available under the terms of the eclipse public licen[sc]e v(ersion)? ?{1;2} 0
unlicense | 1 | domain | this is free and unencumbered software released into the public domain
zlib | 1 | misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
wtfpl | 1 | fuck | you just do what the fuck you want to
boost-1.0 | 1 | boost licen | distributed under the boost software licen[sc]e version 1 0
cc0-1.0 | 1 | waived | waived all copyright and related or neighbo(u)?ring rights
cc-by | 1 | attribution | this work is licen[sc]ed under (a|the) creative commons attribution( \d \d)? (international|unported|generic)? ?licen[sc]e
cc-by-sa | 1 | attribution | this work is licen[sc]ed under (a|the) creative commons attribution share ?alike
cc-by-nc | 1 | attribution | this work is licen[sc]ed under (a|the) creative commons attribution non ?commercial
cc-by-nd | 1 | attribution | this work is licen[sc]ed under (a|the) creative commons attribution no ?deriv(ative)?s
{cc-by-1.0;cc-by-2.0;cc-by-2.5;cc-by-3.0;cc-by-4.0} | 1 | creativecommons | creativecommons org licen[sc]es by {1 0;2 0;2 5;3 0;4 0}
{cc-by-sa-1.0;cc-by-sa-2.0;cc-by-sa-2.5;cc-by-sa-3.0;cc-by-sa-4.0} | 1 | creativecommons | creativecommons org licen[sc]es by sa {1 0;2 0;2 5;3 0;4 0}
{cc-by-nc-2.0;cc-by-nc-2.5;cc-by-nc-3.0;cc-by-nc-4.0} | 1 | creativecommons | creativecommons org licen[sc]es by nc {2 0;2 5;3 0;4 0}
{cc-by-nd-2.0;cc-by-nd-2.5;cc-by-nd-3.0;cc-by-nd-4.0} | 1 | creativecommons | creativecommons org licen[sc]es by nd {2 0;2 5;3 0;4 0}
{cc-by-nc-sa-2.0;cc-by-nc-sa-2.5;cc-by-nc-sa-3.0;cc-by-nc-sa-4.0} | 1 | creativecommons | creativecommons org licen[sc]es by nc sa {2 0;2 5;3 0;4 0}
{cc-by-nc-nd-2.0;cc-by-nc-nd-2.5;cc-by-nc-nd-3.0;cc-by-nc-nd-4.0} | 1 | creativecommons | creativecommons org licen[sc]es by nc nd {2 0;2 5;3 0;4 0}
cc0-1.0 | 1 | creativecommons | creativecommons org publicdomain zero 1 0
cc-pdm-1.0 | 1 | creativecommons | creativecommons org publicdomain mark 1 0
{gpl-1.0;gpl-2.0;gpl-3.0} | 2 | licen | gnu general public licen[sc]e( gpl)? v(ersion)? ?{1;2;3}( 0)?
{gpl-1.0;gpl-2.0;gpl-3.0} | 2 | gpl | (gnu )?gpl ?v?(ersion)? ?{1;2;3}( 0)?
{gpl-2.0-or-later;gpl-3.0-or-later} | 2 | gpl | (gnu )?gpl ?v?(ersion)? ?{2;3}( 0)? or (any )?later( version)?
{lgpl-2.0;lgpl-2.1;lgpl-3.0} | 2 | licen | gnu (lesser|library) general public licen[sc]e( lgpl)? v(ersion)? ?{2 0;2 1;3( 0)?}
{lgpl-2.0;lgpl-2.1;lgpl-3.0} | 2 | lgpl | (gnu )?lgpl ?v?(ersion)? ?{2 0;2 1;3( 0)?}
agpl-3.0 | 2 | licen | gnu affero general public licen[sc]e( agpl)? v(ersion)? ?3( 0)?
agpl-3.0 | 2 | agpl | (gnu )?agpl ?v?(ersion)? ?3( 0)?
{gfdl-1.1;gfdl-1.2;gfdl-1.3} | 2 | licen | gnu free documentation licen[sc]e( gfdl| fdl)? v(ersion)? ?{1 1;1 2;1 3}
{apache-1.0;apache-1.1;apache-2.0} | 2 | apache | apache (software )?licen[sc]e v?(ersion)? ?{1 0;1 1;2 0}
apache-2.0 | 2 | apache | apache 2( 0)? licen[sc]e
bsd-2-clause | 2 | bsd | (simplified bsd|freebsd) licen[sc]e
bsd-3-clause | 2 | bsd | (new|revised|modified) bsd licen[sc]e
bsd-4-clause | 2 | bsd | (original|old) bsd licen[sc]e
{bsd-2-clause;bsd-3-clause;bsd-4-clause} | 2 | bsd | bsd {2;3;4} clause( licen[sc]e)?
{bsd-2-clause;bsd-3-clause;bsd-4-clause} | 2 | bsd | {2;3;4} clause bsd( licen[sc]e)?
{mpl-1.0;mpl-1.1;mpl-2.0} | 2 | mozilla | mozilla public licen[sc]e( mpl)? v?(ersion)? ?{1 0;1 1;2 0}
{mpl-1.0;mpl-1.1;mpl-2.0} | 2 | mpl | mpl ?v?(ersion)? ?{1 0;1 1;2 0}
{epl-1.0;epl-2.0} | 2 | eclipse | eclipse public licen[sc]e( epl)? v?(ersion)? ?{1 0;2 0}
{cddl-1.0;cddl-1.1} | 2 | licen | common development and distribution licen[sc]e( cddl)? v?(ersion)? ?1 {0;1}
{eupl-1.1;eupl-1.2} | 2 | licen | european union public licen[sc]e( eupl)? v?(ersion)? ?1 {1;2}
{artistic-1.0;artistic-2.0} | 2 | artistic | artistic licen[sc]e v?(ersion)? ?{1;2}( 0)?
{ofl-1.0;ofl-1.1} | 2 | font licen | (sil )?open font licen[sc]e v?(ersion)? ?1 {0;1}
{afl-2.1;afl-3.0} | 2 | academic | academic free licen[sc]e v?(ersion)? ?{2 1;3 0}
{osl-2.1;osl-3.0} | 2 | open licen | open software licen[sc]e v?(ersion)? ?{2 1;3 0}
{ecl-1.0;ecl-2.0} | 2 | educational | educational community licen[sc]e v?(ersion)? ?{1;2} 0
boost-1.0 | 2 | boost licen | boost software licen[sc]e v?(ersion)? ?1 0
{cc-by-1.0;cc-by-2.0;cc-by-2.5;cc-by-3.0;cc-by-4.0} | 2 | cc | cc by {1 0;2 0;2 5;3 0;4 0}
{cc-by-sa-1.0;cc-by-sa-2.0;cc-by-sa-2.5;cc-by-sa-3.0;cc-by-sa-4.0} | 2 | cc | cc by sa {1 0;2 0;2 5;3 0;4 0}
{cc-by-nc-2.0;cc-by-nc-2.5;cc-by-nc-3.0;cc-by-nc-4.0} | 2 | cc | cc by nc {2 0;2 5;3 0;4 0}
{cc-by-nd-2.0;cc-by-nd-2.5;cc-by-nd-3.0;cc-by-nd-4.0} | 2 | cc | cc by nd {2 0;2 5;3 0;4 0}
{cc-by-nc-sa-2.0;cc-by-nc-sa-2.5;cc-by-nc-sa-3.0;cc-by-nc-sa-4.0} | 2 | cc | cc by nc sa {2 0;2 5;3 0;4 0}
{cc-by-nc-nd-2.0;cc-by-nc-nd-2.5;cc-by-nc-nd-3.0;cc-by-nc-nd-4.0} | 2 | cc | cc by nc nd {2 0;2 5;3 0;4 0}
{cc-by-2.0;cc-by-3.0;cc-by-4.0} | 2 | attribution | (creative commons )?attribution {2 0;3 0;4 0}( international| unported| generic)
{cc-by-sa-3.0;cc-by-sa-4.0} | 2 | attribution | (creative commons )?attribution share ?alike {3 0;4 0}( international| unported)
cc0-1.0 | 2 | cc0 | cc0 1 0( universal)?
mit-0 | 2 | mit licen | mit (0|no attribution) licen[sc]e
{python-2.0;python-3.0} | 2 | python licen | python software foundation licen[sc]e v?(ersion)? ?{2;3}( 0)?
{zpl-2.0;zpl-2.1} | 2 | zope | zope public licen[sc]e v?(ersion)? ?{2 0;2 1}
{odbl-1.0;odc-by-1.0} | 2 | open licen | open {database|data commons open database;data commons attribution} licen[sc]e v?(ersion)? ?1 0
ms-pl | 2 | microsoft | microsoft public licen[sc]e( ms pl)?
ms-rl | 2 | microsoft | microsoft reciprocal licen[sc]e( ms rl)?
{qpl-1.0;cpl-1.0;ipl-1.0} | 2 | public licen | (the )?{q;common;ibm} public licen[sc]e v?(ersion)? ?1 0
openssl | 2 | openssl | openssl (licen[sc]e|toolkit licen[sc]e)
{elastic-1.0;elastic-2.0} | 2 | elastic | elastic licen[sc]e v?(ersion)? ?{1;2}( 0)?
sspl-1.0 | 2 | server licen | server side public licen[sc]e( sspl)?( v?(ersion)? ?1( 0)?)?
bsl-1.1 | 2 | business licen | business source licen[sc]e( bsl)?( v?(ersion)? ?1( 1)?)?
polyform-noncommercial | 2 | polyform | polyform noncommercial licen[sc]e
openrail | 2 | rail licen | (open rail|openrail|creativeml open rail) ?m? licen[sc]e
gpl | 3 | licen | gnu general public licen[sc]e
lgpl | 3 | licen | gnu (lesser|library) general public licen[sc]e
agpl | 3 | licen | gnu affero general public licen[sc]e
gfdl | 3 | licen | gnu free documentation licen[sc]e
gpl | 3 | gpl | gpl licen[sc]ed?
lgpl | 3 | lgpl | lgpl licen[sc]ed?
agpl | 3 | agpl | agpl licen[sc]ed?
apache | 3 | apache | apache (software )?licen[sc]ed?
mit | 3 | mit licen | mit (x11 |expat )?licen[sc]ed?
mit | 3 | expat licen | expat licen[sc]e
x11 | 3 | x11 licen | x11 licen[sc]e
bsd | 3 | bsd | bsd (style )?licen[sc]ed?
isc | 3 | isc licen | isc licen[sc]ed?
zlib | 3 | zlib | zlib( libpng)? licen[sc]e
mpl | 3 | mozilla | mozilla public licen[sc]e
epl | 3 | eclipse | eclipse public licen[sc]e
cddl | 3 | licen | common development and distribution licen[sc]e
eupl | 3 | licen | european union public licen[sc]e
artistic | 3 | artistic | artistic licen[sc]e
boost-1.0 | 3 | boost licen | boost (software )?licen[sc]e
wtfpl | 3 | wtfpl | wtfpl( licen[sc]e)?
unlicense | 3 | unlicense | (the )?unlicense
cc0 | 3 | cc0 | cc0( licen[sc]e)?
cc-by | 3 | cc | cc by
cc-by-sa | 3 | cc | cc by sa
cc-by-nc | 3 | cc | cc by nc
cc-by-nd | 3 | cc | cc by nd
cc-by-nc-sa | 3 | cc | cc by nc sa
cc-by-nc-nd | 3 | cc | cc by nc nd
cc-by | 3 | attribution | creative commons attribution( licen[sc]e)?
cc-by-sa | 3 | attribution | creative commons attribution share ?alike( licen[sc]e)?
cc-by-nc | 3 | attribution | creative commons attribution non ?commercial( licen[sc]e)?
cc-by-nd | 3 | attribution | creative commons attribution no ?deriv(ative)?s( licen[sc]e)?
creative-commons | 3 | creative | creative commons (public )?licen[sc]e
ofl | 3 | font licen | (sil )?open font licen[sc]e
python | 3 | python licen | python (software foundation )?licen[sc]e
php | 3 | php licen | php licen[sc]e
ruby | 3 | ruby licen | ruby licen[sc]e
perl | 3 | perl itself | same terms as perl itself
postgresql | 3 | postgres | postgres(ql)? licen[sc]e
ncsa | 3 | ncsa | (university of illinois )?ncsa( open source)? licen[sc]e
vim | 3 | vim licen | vim licen[sc]e
odbl | 3 | odbl | (odc )?odbl( licen[sc]e)?
bsl | 3 | business licen | business source licen[sc]e
sspl | 3 | sspl | sspl( licen[sc]ed)?
beerware | 3 | beer | beer ?ware( licen[sc]e)?
jquery | 3 | jquery | jquery licen[sc]e
json | 3 | evil | shall be used for good not evil
public-domain | 3 | domain | (released|placed|dedicated) (in)?to the public domain
public-domain | 3 | domain | in the public domain
commercial | 3 | commercial licen | commercial licen[sc]e( agreement)?
proprietary | 3 | proprietary | proprietary (and confidential|licen[sc]e|software)
proprietary | 3 | reserved | all rights reserved
proprietary | 3 | confidential | (strictly )?confidential (and|or) proprietary
eula | 3 | user licen | end user licen[sc]e agreement
gpl | 4 | gpl | gpl
lgpl | 4 | lgpl | lgpl
agpl | 4 | agpl | agpl
notice | 4 | licensed | licensed under (the|a)
notice | 4 | licenced | licenced under (the|a)
notice | 4 | license agreement | license agreement
notice | 4 | terms licen | (under|to) the terms of the licen[sc]e
notice | 4 | copyright | copyright( c)? (19|20)\d\d
notice | 4 | see licen | see the licen[sc]e( file)?
notice | 4 | spdx | spdx license identifier
"""

#: A character of a word, and one that belongs to none.
#: What separates words: all of ASCII but letters and digits, one by one, as a set of single characters is matched far faster than ranges.
_BETWEEN = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
WORD, GAP = f"[^{_BETWEEN}]", f"[{_BETWEEN}]"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str


def whole(words: str) -> str:
    """The pattern of a rule as a regular expression over a text of any case."""
    body = words.replace(" ?", f"{GAP}*").replace(" ", f"{GAP}+")
    return f"(?i)(?<!{WORD})(?:{body})(?!{WORD})"


def _variants(line: str) -> list[str]:
    sets = re.findall(r"\{([^{}]*;[^{}]*)\}", line)
    if not sets:
        return [line]
    choices = [x.split(";") for x in sets]
    out = []
    for k in range(len(choices[0])):
        parts = iter([x[k] for x in choices])
        out.append(re.sub(r"\{[^{}]*;[^{}]*\}", lambda m: (lambda x: f"(?:{x})" if "|" in x else x)(next(parts)), line))  # noqa: B023
    return out


def rules() -> list[Rule]:
    """All rules, in the order in which they were written."""
    out = []
    for line in TEXT.strip().splitlines():
        for one in _variants(line):
            label, priority, keywords, pattern = (x.strip() for x in one.split(" | ", 3))
            out.append(Rule(label, int(priority), tuple(keywords.split()), whole(pattern)))
    return out


#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
