"""Signature rules of license scans, written by hand: a line for each, in order of priority.

label | confidence | pattern over lower-case words with one space between them
"""

from __future__ import annotations

import re

RULES = """
# Identifiers that say which license holds
mit | 1.0 | spdx license identifier mit
mit-0 | 1.0 | spdx license identifier mit 0
apache-2 | 1.0 | spdx license identifier apache 2 0
apache-1 | 1.0 | spdx license identifier apache 1 [01]
bsd-2-clause | 1.0 | spdx license identifier bsd 2 clause
bsd-3-clause | 1.0 | spdx license identifier bsd 3 clause
bsd-4-clause | 1.0 | spdx license identifier bsd 4 clause
0bsd | 1.0 | spdx license identifier 0bsd
isc | 1.0 | spdx license identifier isc
zlib | 1.0 | spdx license identifier zlib
gpl-2 | 1.0 | spdx license identifier gpl 2 0(?: only| or later)?
gpl-3 | 1.0 | spdx license identifier gpl 3 0(?: only| or later)?
lgpl-2 | 1.0 | spdx license identifier lgpl 2 [01](?: only| or later)?
lgpl-3 | 1.0 | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3 | 1.0 | spdx license identifier agpl 3 0(?: only| or later)?
mpl-1 | 1.0 | spdx license identifier mpl 1 [01]
mpl-2 | 1.0 | spdx license identifier mpl 2 0(?: no copyleft exception)?
epl-1 | 1.0 | spdx license identifier epl 1 0
epl-2 | 1.0 | spdx license identifier epl 2 0
cddl-1 | 1.0 | spdx license identifier cddl 1 [01]
bsl-1 | 1.0 | spdx license identifier bsl 1 0
unlicense | 1.0 | spdx license identifier unlicense
wtfpl | 1.0 | spdx license identifier wtfpl
cc0 | 1.0 | spdx license identifier cc0 1 0
cc-by | 1.0 | spdx license identifier cc by [1-4] [05]
cc-by-sa | 1.0 | spdx license identifier cc by sa [1-4] [05]
cc-by-nc | 1.0 | spdx license identifier cc by nc [1-4] [05]
cc-by-nd | 1.0 | spdx license identifier cc by nd [1-4] [05]
cc-by-nc-sa | 1.0 | spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-nd | 1.0 | spdx license identifier cc by nc nd [1-4] [05]
artistic-2 | 1.0 | spdx license identifier artistic 2 0
ofl-1.1 | 1.0 | spdx license identifier ofl 1 1
eupl-1.2 | 1.0 | spdx license identifier eupl 1 2
psf-2 | 1.0 | spdx license identifier psf 2 0
postgresql | 1.0 | spdx license identifier postgresql
ncsa | 1.0 | spdx license identifier ncsa
ms-pl | 1.0 | spdx license identifier ms pl
odbl-1 | 1.0 | spdx license identifier odbl 1 0
x11 | 1.0 | spdx license identifier x11

# MIT and its relatives: own wording
mit | 0.99 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
mit | 0.97 | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 0.8 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non ?infringement
mit | 0.9 | in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software
mit-0 | 0.97 | mit no attribution
x11 | 0.95 | except as contained in this notice the name of the x consortium shall not be used in advertising
x11 | 0.9 | x11 licen[cs]e
expat | 0.9 | expat licen[cs]e
json | 0.98 | the software shall be used for good not evil
isc | 0.98 | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
0bsd | 0.97 | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! provided)
isc | 0.85 | the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
curl | 0.9 | copyright and permission notice copyright c [0-9 ]+daniel stenberg
hpnd | 0.85 | makes no representations about the suitability of this software for any purpose it is provided as is without express or implied warranty
postgresql | 0.97 | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa | 0.9 | neither the names of .{1,200} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission(?! this)
boost-text | 0.97 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
mit | 0.97 | (?:licensed|released|distributed|published|available|provided|offered|shared|made available) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?mit(?: licen[cs]e)?
mit | 0.95 | under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit | 0.95 | subject to (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit | 0.95 | governed by (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit | 0.95 | covered by (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit | 0.9 | licen[cs]e (?:type |name )?mit
mit | 0.9 | mit licensed
mit | 0.85 | (?:the )?mit licen[cs]e(?: mit)?
mit | 0.7 | mit style licen[cs]e
isc | 0.97 | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?isc(?: licen[cs]e)?
isc | 0.85 | (?:the )?isc licen[cs]e
isc | 0.85 | licen[cs]e isc
zlib | 0.98 | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 0.97 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 0.85 | in no event will the authors be held liable for any damages arising from the use of this software
zlib | 0.9 | (?:the )?zlib(?: libpng)? licen[cs]e
libpng | 0.9 | (?:the )?libpng licen[cs]e(?: version [12](?: 0)?)?

# BSD
bsd-4-clause | 0.98 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause | 0.97 | neither the names? of .{1,200} nor the names of (?:its|the|any) contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3-clause | 0.9 | may not be used to endorse or promote products derived from this software without specific prior written permission
bsd | 0.9 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | 0.85 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | 0.85 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and(?: or)? other materials provided with the distribution
bsd | 0.8 | this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
bsd | 0.85 | this software is provided by the regents and contributors as is and any express or implied warranties
freebsd-doc | 0.9 | freebsd documentation licen[cs]e
bsd-2-clause | 0.97 | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?bsd 2 clause(?: licen[cs]e)?
bsd-2-clause | 0.97 | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?2 clause bsd(?: licen[cs]e)?
bsd-3-clause | 0.97 | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?bsd 3 clause(?: licen[cs]e)?
bsd-3-clause | 0.97 | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?3 clause bsd(?: licen[cs]e)?
bsd-2-clause | 0.9 | bsd 2 clause(?: licen[cs]e)?
bsd-2-clause | 0.9 | 2 clause bsd(?: licen[cs]e)?
bsd-2-clause | 0.9 | bsd two clause(?: licen[cs]e)?
bsd-2-clause | 0.9 | two clause bsd(?: licen[cs]e)?
bsd-2-clause | 0.9 | simplified bsd(?: licen[cs]e)?
bsd-2-clause | 0.85 | freebsd licen[cs]e
bsd-3-clause | 0.9 | bsd 3 clause(?: licen[cs]e)?
bsd-3-clause | 0.9 | 3 clause bsd(?: licen[cs]e)?
bsd-3-clause | 0.9 | bsd three clause(?: licen[cs]e)?
bsd-3-clause | 0.9 | three clause bsd(?: licen[cs]e)?
bsd-3-clause | 0.9 | new bsd licen[cs]e
bsd-3-clause | 0.9 | modified bsd licen[cs]e
bsd-3-clause | 0.9 | revised bsd licen[cs]e
bsd-3-clause-clear | 0.9 | clear bsd licen[cs]e
bsd-4-clause | 0.9 | bsd 4 clause(?: licen[cs]e)?
bsd-4-clause | 0.9 | 4 clause bsd(?: licen[cs]e)?
bsd-4-clause | 0.9 | original bsd licen[cs]e
bsd-4-clause | 0.85 | old bsd licen[cs]e
0bsd | 0.9 | 0bsd(?: licen[cs]e)?
0bsd | 0.9 | zero clause bsd(?: licen[cs]e)?
bsd | 0.9 | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the |a )?bsd(?: style)?(?: licen[cs]e)?
bsd | 0.8 | (?:the |a )?bsd licen[cs]e
bsd | 0.7 | bsd style licen[cs]e
bsd | 0.75 | licen[cs]e bsd

# Apache
apache-2 | 0.99 | licensed under the apache licen[cs]e version 2(?: 0)?(?: the license you may not use this (?:file|software|work) except in compliance with the license)?
apache-2 | 0.95 | you may not use this file except in compliance with the license you may obtain a copy of the license at(?: https?)? www apache org licenses license 2 0
apache-2 | 0.95 | www apache org licenses license 2 0(?: txt| html)?
apache-2 | 0.85 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2 | 0.85 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce
apache-2 | 0.95 | apache licen[cs]e version 2 0 january 2004
apache-2 | 0.97 | (?:licensed|released|distributed|published|available|provided|offered) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?apache(?: software)?(?: licen[cs]e)? (?:version |v )?2(?: 0)?(?: licen[cs]e)?
apache-2 | 0.9 | (?:the )?apache(?: software)? licen[cs]e version 2(?: 0)?
apache-2 | 0.9 | (?:the )?apache(?: software)? licen[cs]e (?:v )?2(?: 0)?
apache-2 | 0.9 | apache (?:v )?2(?: 0)? licen[cs]e
apache-2 | 0.9 | (?:the )?apache(?: software)? licen[cs]e v2(?: 0)?
apache-2 | 0.85 | apache (?:version )?2 0
apache-1 | 0.9 | (?:the )?apache(?: software)? licen[cs]e version 1(?: [01])?
apache-1 | 0.9 | (?:the )?apache(?: software)? licen[cs]e (?:v )?1(?: [01])?
apache-1 | 0.9 | this product includes software developed by the apache (?:software foundation|group)
apache | 0.75 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?apache licen[cs]e(?! (?:version |v ?)?[12])
apache | 0.6 | (?:the )?apache licen[cs]e(?! (?:version |v ?)?[12])

# GNU
gpl-3 | 0.99 | redistribute it and(?: or)? modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3(?: of the licen[cs]e)?(?: or at your option any later version)?
gpl-2 | 0.99 | redistribute it and(?: or)? modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2(?: of the licen[cs]e)?(?: or at your option any later version)?
gpl-2 | 0.99 | under the terms of the gnu general public licen[cs]e version 2 as published by the free software foundation
gpl-3 | 0.98 | gnu general public licen[cs]e version 3 29 june 2007
gpl-2 | 0.98 | gnu general public licen[cs]e version 2 june 1991
gpl | 0.8 | this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
gpl | 0.85 | you should have received a copy of the gnu general public licen[cs]e along with this (?:program|software|file|library)
lgpl-2 | 0.99 | redistribute it and(?: or)? modify it under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 2(?: 1)?(?: of the licen[cs]e)?(?: or at your option any later version)?
lgpl-3 | 0.99 | redistribute it and(?: or)? modify it under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation either version 3(?: of the licen[cs]e)?(?: or at your option any later version)?
lgpl-2 | 0.99 | redistribute it and(?: or)? modify it under the terms of the gnu library general public licen[cs]e as published by the free software foundation either version 2(?: of the licen[cs]e)?(?: or at your option any later version)?
lgpl | 0.85 | you should have received a copy of the gnu lesser general public licen[cs]e along with this (?:program|software|file|library)
agpl-3 | 0.99 | redistribute it and(?: or)? modify it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation either version 3(?: of the licen[cs]e)?(?: or at your option any later version)?
agpl-3 | 0.9 | you should have received a copy of the gnu affero general public licen[cs]e along with this (?:program|software|file|library)
gpl-3 | 0.98 | (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e (?:version |v )?3(?: 0)?(?: or (?:any )?later)?
gpl-2 | 0.98 | (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e (?:version |v )?2(?: 0)?(?: or (?:any )?later)?
gpl-1 | 0.9 | gnu general public licen[cs]e version 1(?: 0)?
gpl-2 | 0.9 | gnu general public licen[cs]e (?:version |v )?2(?: 0)?(?: only| or (?:any )?later(?: version)?)?
gpl-3 | 0.9 | gnu general public licen[cs]e (?:version |v )?3(?: 0)?(?: only| or (?:any )?later(?: version)?)?
gpl-2 | 0.9 | gnu general public licen[cs]e v2(?: 0)?
gpl-3 | 0.9 | gnu general public licen[cs]e v3(?: 0)?
lgpl-2 | 0.9 | gnu lesser general public licen[cs]e (?:version |v )?2(?: [01])?(?: only| or (?:any )?later(?: version)?)?
lgpl-2 | 0.9 | gnu lesser general public licen[cs]e v2(?: [01])?
lgpl-3 | 0.9 | gnu lesser general public licen[cs]e (?:version |v )?3(?: 0)?(?: only| or (?:any )?later(?: version)?)?
lgpl-3 | 0.9 | gnu lesser general public licen[cs]e v3(?: 0)?
lgpl-2 | 0.9 | gnu library general public licen[cs]e (?:version |v )?2(?: 0)?
lgpl-2 | 0.9 | gnu library general public licen[cs]e v2(?: 0)?
agpl-3 | 0.9 | gnu affero general public licen[cs]e (?:version |v )?3(?: 0)?
agpl-3 | 0.9 | gnu affero general public licen[cs]e v3(?: 0)?
agpl-3 | 0.8 | (?:gnu )?affero general public licen[cs]e
lgpl | 0.75 | gnu lesser general public licen[cs]e
lgpl | 0.75 | gnu library general public licen[cs]e
gpl | 0.75 | gnu general public licen[cs]e
gfdl | 0.98 | permission is granted to copy distribute and(?: or)? modify this document under the terms of the gnu free documentation licen[cs]e
gfdl | 0.9 | gnu free documentation licen[cs]e(?: version 1 [1-3])?
gpl-2 | 0.85 | (?:gnu )?gpl (?:version |v )?2(?: 0)?
gpl-2 | 0.85 | (?:gnu )?gpl v2(?: 0)?
gpl-2 | 0.85 | (?:gnu )?gplv2
gpl-3 | 0.85 | (?:gnu )?gpl (?:version |v )?3(?: 0)?
gpl-3 | 0.85 | (?:gnu )?gpl v3(?: 0)?
gpl-3 | 0.85 | (?:gnu )?gplv3
lgpl-2 | 0.85 | (?:gnu )?lgpl (?:version |v )?2(?: [01])?
lgpl-2 | 0.85 | (?:gnu )?lgpl v2(?: [01])?
lgpl-3 | 0.85 | (?:gnu )?lgpl (?:version |v )?3(?: 0)?
lgpl-3 | 0.85 | (?:gnu )?lgpl v3(?: 0)?
lgpl-3 | 0.85 | (?:gnu )?lgplv3
agpl-3 | 0.85 | (?:gnu )?agpl (?:version |v )?3(?: 0)?
agpl-3 | 0.85 | (?:gnu )?agpl v3(?: 0)?
agpl-3 | 0.85 | (?:gnu )?agplv3
gpl | 0.75 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
gpl | 0.7 | (?:gnu )?gpl licen[cs]e
gpl-exception | 0.8 | as a special exception .{1,120} permission to link this (?:library|program)
classpath | 0.85 | (?:gnu )?classpath exception

# Mozilla, Eclipse and other weak copyleft
mpl-2 | 0.99 | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-2 | 0.95 | if a copy of the mpl was not distributed with this file you can obtain one at(?: https?)? mozilla org mpl 2 0
mpl-1 | 0.99 | the contents of this file are subject to the mozilla public licen[cs]e version 1 [01]
mpl-2 | 0.9 | mozilla public licen[cs]e (?:version |v )?2(?: 0)?
mpl-2 | 0.9 | mozilla public licen[cs]e v2(?: 0)?
mpl-1 | 0.9 | mozilla public licen[cs]e (?:version |v )?1(?: [01])?
mpl | 0.75 | mozilla public licen[cs]e
mpl-2 | 0.85 | mpl (?:version |v )?2(?: 0)?
mpl-2 | 0.85 | mpl v2(?: 0)?
epl-2 | 0.99 | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v )?2 0
epl-1 | 0.99 | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v )?1 0
epl-2 | 0.9 | eclipse public licen[cs]e (?:version |v )?2(?: 0)?
epl-1 | 0.9 | eclipse public licen[cs]e (?:version |v )?1(?: 0)?
epl | 0.75 | eclipse public licen[cs]e
edl-1 | 0.9 | eclipse distribution licen[cs]e(?: v 1 0)?
cpl-1 | 0.85 | common public licen[cs]e(?: version)?(?: 1 0)?
ipl-1 | 0.85 | ibm public licen[cs]e(?: version)?(?: 1 0)?
cddl-1 | 0.98 | subject to the terms of the common development and distribution licen[cs]e
cddl-1 | 0.9 | common development and distribution licen[cs]e(?: version)?(?: 1 [01])?
cddl-1 | 0.85 | cddl (?:version |v )?1 [01]
cddl-1 | 0.8 | cddl licen[cs]e
eupl-1.2 | 0.95 | european union public licen[cs]e (?:version |v )?1 2
eupl | 0.85 | european union public licen[cs]e
eupl | 0.95 | licensed under the eupl
cecill | 0.9 | cecill (?:b |c )?(?:free software )?licen[cs]e
osl-3 | 0.9 | open software licen[cs]e (?:version |v )?3(?: 0)?
afl-3 | 0.9 | academic free licen[cs]e (?:version |v )?3(?: 0)?
apsl-2 | 0.9 | apple public source licen[cs]e(?: version)?(?: 2(?: 0)?)?
ms-pl | 0.9 | microsoft public licen[cs]e
ms-rl | 0.9 | microsoft reciprocal licen[cs]e
sleepycat | 0.9 | sleepycat licen[cs]e

# Creative Commons
cc0 | 0.97 | to the extent possible under law .{1,200} has waived all copyright and related or neighboring rights to
cc0 | 0.97 | cc0 1 0 universal(?: public domain dedication)?
cc0 | 0.95 | creative commons zero(?: v 1 0| v1 0)?(?: universal)?
cc0 | 0.9 | cc0 (?:version )?1(?: 0)?
cc0 | 0.8 | cc0(?: licen[cs]e)?
cc-by-nc-nd | 0.97 | creative commons attribution noncommercial noderiv(?:ative)?s(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
cc-by-nc-nd | 0.97 | creative commons attribution non commercial no deriv(?:ative)?s(?: works)?(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
cc-by-nc-sa | 0.97 | creative commons attribution noncommercial sharealike(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
cc-by-nc-sa | 0.97 | creative commons attribution non commercial share alike(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
cc-by-nc | 0.95 | creative commons attribution noncommercial(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
cc-by-nc | 0.95 | creative commons attribution non commercial(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
cc-by-sa | 0.95 | creative commons attribution sharealike(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
cc-by-sa | 0.95 | creative commons attribution share alike(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
cc-by-nd | 0.95 | creative commons attribution noderiv(?:ative)?s(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
cc-by-nd | 0.95 | creative commons attribution no deriv(?:ative)?s(?: works)?(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
cc-by | 0.9 | creative commons attribution(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?
cc-by | 0.9 | creative commons by(?: [1-4] [05])?(?! (?:nc|sa|nd))
cc-by-nc-nd | 0.97 | creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc-sa | 0.97 | creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc | 0.97 | creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-sa | 0.97 | creativecommons org licenses by sa(?: [1-4] [05])?
cc-by-nd | 0.97 | creativecommons org licenses by nd(?: [1-4] [05])?
cc-by | 0.97 | creativecommons org licenses by(?: [1-4] [05])?
cc0 | 0.97 | creativecommons org publicdomain zero 1 0
cc-by-nc-nd | 0.9 | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | 0.9 | cc by nc sa(?: [1-4] [05])?
cc-by-nc | 0.9 | cc by nc(?: [1-4] [05])?
cc-by-sa | 0.9 | cc by sa(?: [1-4] [05])?
cc-by-nd | 0.9 | cc by nd(?: [1-4] [05])?
cc-by | 0.85 | cc by [1-4] [05]
cc-by | 0.9 | (?:licensed|released|published|available|shared) under (?:the )?(?:terms of )?(?:a |the )?cc by(?: licen[cs]e)?
cc | 0.7 | (?:a |the )?creative commons licen[cs]e
cc | 0.6 | licensed under (?:a |the )?creative commons

# Public domain and its like
unlicense | 0.98 | this is free and unencumbered software released into the public domain
unlicense | 0.95 | anyone is free to copy modify publish use compile sell or distribute this software
unlicense | 0.85 | (?:the )?unlicense(?: licen[cs]e)?
wtfpl | 0.98 | do what the fuck you want to(?: public licen[cs]e)?
wtfpl | 0.9 | wtfpl(?: licen[cs]e)?
beerware | 0.95 | the beer ware licen[cs]e
beerware | 0.9 | beerware licen[cs]e
public-domain | 0.85 | released (?:in|into|to) the public domain
public-domain | 0.85 | placed (?:in|into) the public domain
public-domain | 0.85 | dedicated to the public domain
public-domain | 0.7 | this (?:work|file|software|text|book) is (?:in|part of) the public domain
public-domain | 0.8 | public domain dedication
public-domain | 0.9 | the author disclaims copyright to this source code

# Other named licenses
bsl-1 | 0.98 | distributed under the boost software licen[cs]e version 1 0
bsl-1 | 0.9 | boost software licen[cs]e(?: version| v)?(?: 1(?: 0)?)?
artistic-2 | 0.9 | artistic licen[cs]e (?:version |v )?2(?: 0)?
artistic-1 | 0.9 | artistic licen[cs]e (?:version |v )?1(?: 0)?
artistic | 0.75 | (?:the )?artistic licen[cs]e
perl | 0.95 | under the same terms as perl itself
ofl-1.1 | 0.98 | this font software is licensed under the sil open font licen[cs]e version 1 1
ofl-1.1 | 0.9 | (?:sil )?open font licen[cs]e(?: version)?(?: 1 1)?
psf-2 | 0.9 | python software foundation licen[cs]e(?: version 2)?
psf-2 | 0.85 | psf licen[cs]e
php-3 | 0.95 | the php licen[cs]e version 3 01
php-3 | 0.9 | this product includes php software freely available from
php-3 | 0.85 | (?:the )?php licen[cs]e
ruby | 0.85 | (?:the )?ruby licen[cs]e
ruby | 0.85 | licensed under the same terms as ruby
vim | 0.85 | (?:the )?vim licen[cs]e
postgresql | 0.9 | (?:the )?postgresql licen[cs]e
openssl | 0.95 | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 0.9 | (?:the )?openssl licen[cs]e
ssleay | 0.9 | this product includes cryptographic software written by eric young
ncsa | 0.95 | university of illinois ncsa open source licen[cs]e
w3c | 0.9 | w3c software (?:and document )?notice and licen[cs]e
w3c | 0.8 | w3c licen[cs]e
icu | 0.85 | icu licen[cs]e
unicode | 0.9 | unicode inc licen[cs]e agreement data files and software
zpl-2 | 0.9 | zope public licen[cs]e(?: zpl)?(?: version)?(?: 2 [01])?
lppl-1 | 0.95 | latex project public licen[cs]e(?: version)?(?: 1 [0-3])?
qpl-1 | 0.8 | the q public licen[cs]e version 1 0
tcl | 0.8 | the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose provided that existing copyright notices are retained
odbl-1 | 0.95 | open (?:data commons )?(?:open )?database licen[cs]e(?: odbl)?(?: v?1 0)?
odc-by | 0.95 | open data commons attribution licen[cs]e
pddl-1 | 0.9 | open data commons public domain dedication and licen[cs]e
cdla | 0.95 | community data licen[cs]e agreement (?:permissive|sharing)(?: version)?(?: [12] 0)?
ogl-uk | 0.95 | open government licence(?: v?[123](?: 0)?)?
etalab | 0.95 | licence ouverte(?: open licence)? (?:etalab|version 2 0)
sspl-1 | 0.97 | server side public licen[cs]e(?: v?1)?
elastic-2 | 0.95 | elastic licen[cs]e (?:version |v )?2(?: 0)?
elastic | 0.8 | elastic licen[cs]e
busl-1 | 0.97 | business source licen[cs]e(?: version)?(?: 1 1)?
commons-clause | 0.97 | commons clause licen[cs]e condition(?: v1 0)?
polyform | 0.95 | polyform (?:noncommercial|small business|strict|shield|perimeter) licen[cs]e
openrail | 0.95 | (?:creativeml |bigscience )?openrail (?:m |s |d )?licen[cs]e
openrail | 0.95 | (?:creativeml |bigscience )?open rail (?:m |s |d )?licen[cs]e
openrail | 0.9 | responsible ai licen[cs]e
llama | 0.95 | llama [0-9 ]*community licen[cs]e(?: agreement)?
hippocratic | 0.95 | hippocratic licen[cs]e(?: version)?(?: [123] [0-9])?
anti-996 | 0.95 | anti 996 licen[cs]e

# Proprietary notices
proprietary | 0.8 | proprietary and confidential(?: information)?
proprietary | 0.8 | confidential and proprietary(?: information)?
proprietary | 0.85 | unauthori[sz]ed copying of this file via any medium is strictly prohibited
proprietary | 0.8 | no part of this (?:publication|book|work) may be reproduced .{0,160} without (?:the )?(?:prior )?(?:written )?permission
proprietary | 0.6 | for personal non commercial use only
eula | 0.85 | end user licen[cs]e agreement
all-rights-reserved | 0.6 | all rights reserved
all-rights-reserved | 0.6 | tous droits réservés
all-rights-reserved | 0.6 | alle rechte vorbehalten
all-rights-reserved | 0.6 | todos los derechos reservados
copyright | 0.5 | copyright (?:c )?(?:by )?(?:19|20)[0-9]{2}
copyright | 0.5 | c copyright (?:by )?(?:19|20)[0-9]{2}
"""

#: Words that many texts have and that a prefilter gains nothing from.
COMMON = set("a an and any are as at be by for from in is it its may not of on or that the this to under was will with without you your".split())
#: Keywords of a rule, at most.
KEYWORDS = 4


GROUP = re.compile(r"\((\?:|\?!)([^()]*)\)\??")


def keywords(pattern: str) -> list[str]:
    """Words that every match has: those outside of groups that don't vary, the longest first."""
    flat = pattern
    while m := GROUP.search(flat):  # an inner group first
        # A group that brings its own space leaves the words beside it whole.
        apart = m[1] == "?!" or m[2].startswith(" ") or m[2].endswith(" ")
        flat = flat[: m.start()] + (" " if apart else "|") + flat[m.end() :]
    flat = re.sub(r"\[[^]]*\][+*]?|.\?", "|", flat)
    words = [w for w in flat.split() if re.fullmatch(r"[^\W_]+", w)]
    return sorted(dict.fromkeys([w for w in words if w not in COMMON] or words), key=lambda w: (-len(w), w))[:KEYWORDS]


def read(text: str = RULES) -> list[tuple[str, list[str], float, str]]:
    """Label, keywords, confidence and pattern of each rule."""
    out = []
    for line in text.splitlines():
        if line.strip() and not line.startswith("#"):
            label, sure, pattern = (part.strip() for part in line.split(" | "))
            out.append((label, keywords(pattern), float(sure), pattern))
    return out
