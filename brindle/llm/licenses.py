"""License scans with ordered signature rules.

Rules are regular expressions over a text's lower-cased words joined by spaces. A keyword automaton looks
for the rules' keywords first, and only rules whose keyword occurs are tried. Detections are then taken by
priority; one that lies within a detection already taken is suppressed. Rules are written by hand, one a
line, or for families of licenses made from their names and versions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache
from itertools import product
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import folded_words, map_rows, table

#: Fixed values of the contract: phrases whose words stand consecutively, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Rule(NamedTuple):
    """priority: lower goes first. keyword: must occur in the text for the pattern to be tried."""

    priority: int
    label: str
    keyword: str
    pattern: re.Pattern
    weight: float


class Found(NamedTuple):
    label: str
    first: int
    last: int
    weight: float
    priority: int


def _rule(priority: int, label: str, keyword: str, pattern: str, weight: float) -> Rule:
    return Rule(priority, label, keyword, re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])"), weight)


#: Words that make a bare name and number a license.
UNDER = r"(?:under|licen[cs]ed?|terms of|conditions of|license identifier)(?: the)?(?: terms of)?(?: the)?(?: gnu)? "
LICENSED = r"licen[cs](?:es?|ed|ing)"
GRANTED = r"(?:licen[cs]ed|released|distributed|available|published|provided|offered) under (?:the )?(?:terms of )?"
#: Words after `license` that make it another thing.
OTHER_THING = r"(?! (?:plates?|numbers?|keys?|fees?|servers?|managers?|holders?|exams?|tags?|renewals?))"
#: What stands right before a mention that denies it.
DENIED = re.compile(r"(?:^| )(?:not|never|neither|isn t|aren t|cannot be|no longer)(?: be| been)?(?: (?:licen[cs]ed|released|distributed|available|published|provided|covered))?(?: under| by)?(?: the)?(?: terms of)?(?: the)?(?: gnu)? $")

#: Hand-written signatures, one a line: label | keyword | pattern | priority | weight. The pattern matches whole words.
SIGNATURES = r"""
bsd | bsd license | (?:the )?bsd license | 58 | 0.7
bsd | bsd licence | (?:the )?bsd licence | 58 | 0.7
bsd | bsd licensed | bsd licensed | 58 | 0.7
bsd | bsd style | bsd style licen[cs]ed? | 57 | 0.6
bsd | bsd copyright | bsd copyright (?:notice|terms) | 57 | 0.6
bsd | berkeley software distribution | berkeley software distribution(?: licen[cs]e)? | 57 | 0.6
bsd-2-clause | 2 clause bsd | 2 clause bsd | 54 | 0.8
bsd-2-clause | two clause bsd | two clause bsd(?: licen[cs]e)? | 54 | 0.8
bsd-2-clause | bsd two clause | bsd two clause(?: licen[cs]e)? | 54 | 0.8
bsd-3-clause | 3 clause bsd | 3 clause bsd | 54 | 0.8
bsd-3-clause | three clause bsd | three clause bsd(?: licen[cs]e)? | 54 | 0.8
bsd-3-clause | bsd three clause | bsd three clause(?: licen[cs]e)? | 54 | 0.8
bsd-3-clause-clear | clear bsd | (?:3 clause )?clear bsd(?: licen[cs]e)? | 50 | 0.9
bsd-3-clause-clear | no express or implied licenses | no express or implied licenses to any party s patent rights are granted | 20 | 0.9
bsd-4-clause | advertising materials mentioning | all advertising materials mentioning features or use of this software must display | 16 | 0.95
bsd-3-clause | endorse or promote products | may be used to endorse or promote products derived from this software without specific prior written permission | 19 | 0.8
bsd | redistributions of source code | redistributions of source code must retain the (?:above|accompanying) copyright notice | 25 | 0.8
bsd | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice | 25 | 0.8
bsd-1-clause | bsd 1 clause | bsd 1 clause(?: licen[cs]e)? | 54 | 0.8
mit | mit licensed | mit licensed | 56 | 0.7
mit | massachusetts institute | massachusetts institute of technology licen[cs]e | 56 | 0.7
mit | opensource org licenses mit | opensource org licenses mit(?: license)?(?: php| html)? | 20 | 1.0
mit | above copyright notice and this permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software | 18 | 0.9
mit | mit x11 | mit x11(?: licen[cs]e)? | 54 | 0.8
mit-0 | mit no attribution | mit no attribution(?: licen[cs]e)? | 30 | 0.95
mit-0 | mit 0 | spdx license identifier mit 0 | 21 | 1.0
isc | opensource org licenses isc | opensource org licenses isc(?: license)? | 20 | 1.0
isc | isc licensed | isc licensed | 56 | 0.7
apache-2 | apache 2 | apache 2 0 licen[cs]ed? | 40 | 0.8
apache-2 | apache 2 | apache 2 licen[cs]ed? | 40 | 0.8
apache-2 | apache v2 | apache v2(?: 0)?(?: licen[cs]e)? | 40 | 0.8
apache-2 | alv2 | alv2 | 60 | 0.5
apache-2 | asl 2 | (?:under|licen[cs]ed?|the) asl 2(?: 0)? | 60 | 0.6
apache-2 | you may not use this file except | you may not use this file except in compliance with the license you may obtain a copy of the license at | 30 | 0.7
apache-2 | opensource org licenses apache | opensource org licenses apache(?: license)? 2 0 | 20 | 1.0
apache-1.1 | developed by the apache software foundation | this product includes software developed by the apache software foundation | 30 | 0.8
gpl | gpl licensed | gpl licensed | 62 | 0.6
gpl | the gpl | (?:under|of) the gpl | 62 | 0.6
gpl | gnu gpl | gnu gpl | 63 | 0.6
gpl | gnu org licenses gpl | gnu org licenses gpl(?: html| txt| en html)? | 60 | 0.7
gpl-2-or-later | redistribute it and or modify | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version | 8 | 1.0
gpl-3-or-later | redistribute it and or modify | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version | 8 | 1.0
gpl-2-with-classpath-exception | classpath exception | (?:gpl|general public license) ?(?:version |v ?)?2(?: 0)? (?:only )?with (?:the )?classpath exception | 9 | 1.0
gpl-2-with-classpath-exception | link this library with independent modules | permission to link this library with independent modules to produce an executable | 20 | 0.8
gpl-3-with-gcc-exception | gcc runtime library exception | gcc runtime library exception(?: version 3 1)? | 20 | 0.9
gpl-3-with-autoconf-exception | autoconf exception | autoconf exception | 20 | 0.9
gpl-2-with-bison-exception | bison parser skeleton | you may create a larger work that contains part or all of the bison parser skeleton | 20 | 0.9
gpl-2-with-linux-syscall-note | linux syscall note | with linux syscall note | 20 | 1.0
lgpl | the lgpl | (?:under|of) the lgpl | 62 | 0.6
lgpl | gnu lgpl | gnu lgpl | 63 | 0.6
lgpl | lgpl licensed | lgpl licensed | 62 | 0.6
agpl | the agpl | (?:under|of) the agpl | 62 | 0.6
agpl | gnu agpl | gnu agpl | 63 | 0.6
mpl-2.0 | mozilla org mpl 2 0 | mozilla org mpl 2 0 | 18 | 1.0
mpl-2.0 | this source code form is subject to | this source code form is subject to the terms of the mozilla public license v 2 0 | 10 | 1.0
mpl-2.0-no-copyleft-exception | incompatible with secondary licenses | this source code form is incompatible with secondary licenses | 10 | 1.0
mpl-1.1 | mozilla org mpl mpl 1 1 | mozilla org mpl mpl 1 1(?: html)? | 18 | 1.0
mpl | mpl licensed | mpl licensed | 62 | 0.6
epl-1.0 | eclipse org legal epl v10 | eclipse org legal epl v10(?: html)? | 18 | 1.0
epl-2.0 | eclipse org legal epl 2 0 | eclipse org legal epl 2 0 | 18 | 1.0
edl-1.0 | eclipse distribution | eclipse distribution licen[cs]e(?: version| v)?(?: 1 0)? | 20 | 0.9
cddl-1.0 | opensource org licenses cddl | opensource org licenses cddl 1 0 | 18 | 1.0
ipl-1.0 | ibm public | ibm public licen[cs]e(?: version| v)?(?: 1 0)? | 20 | 0.9
spl-1.0 | sun public | sun public licen[cs]e(?: version| v)?(?: 1 0)? | 20 | 0.9
apsl-2.0 | apple public source | apple public source licen[cs]e(?: version| v)?(?: 2 0)? | 20 | 0.9
npl-1.1 | netscape public | netscape public licen[cs]e(?: version| v)?(?: 1 1)? | 20 | 0.9
artistic-2.0 | artistic 2 | (?:under|licen[cs]ed?|the) artistic 2(?: 0)? | 40 | 0.7
artistic-2.0 | artistic 2 0 | artistic 2 0 | 66 | 0.5
artistic | same terms as perl | (?:under )?the same terms as perl(?: itself)? | 30 | 0.7
artistic-perl | perl 5 | same terms as the perl 5 programming language system itself | 20 | 0.9
cc0-1.0 | waived all copyright | (?:has|have) waived all copyright and related or neighboring rights | 20 | 0.9
cc0-1.0 | no copyright reserved | no copyright reserved | 70 | 0.4
unlicense | unlicense org | unlicense org | 18 | 1.0
unlicense | the unlicense | (?:under )?the unlicense | 30 | 0.9
wtfpl | wtfpl net | (?:www )?wtfpl net | 20 | 0.9
beerware | beerware | beerware(?: licen[cs]e)?(?: revision 42)? | 20 | 0.9
beerware | buy me a beer | you can buy me a beer in return | 20 | 0.8
jsonlicense | good not evil | the software shall be used for good not evil | 10 | 1.0
zlib | zlib licensed | zlib licensed | 56 | 0.7
zlib | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented | 20 | 0.9
libpng | png reference library | png reference library licen[cs]e(?: version 2)? | 20 | 0.9
openssl | openssl project | developed by the openssl project for use in the openssl toolkit | 16 | 1.0
ssleay | eric young | (?:includes )?cryptographic software written by eric young | 20 | 0.9
icu | icu | icu licen[cs]e | 30 | 0.9
unicode | unicode data files | unicode data files and (?:any associated documentation|software) | 40 | 0.6
unicode | unicode | unicode licen[cs]e agreement | 20 | 0.9
w3c | w3c software | w3c software (?:and document )?(?:notice and )?licen[cs]e | 20 | 0.9
python-2.0 | psf | psf licen[cs]e agreement(?: for python)? | 20 | 0.9
python-2.0 | python | python licen[cs]e(?: version)? 2(?: 0)? | 30 | 0.8
ruby | same terms as ruby | the same terms as ruby(?: itself)? | 30 | 0.8
ruby | ruby s | ruby s licen[cs]e | 30 | 0.8
php-3.01 | php net license | php net license 3 01(?: txt)? | 18 | 1.0
vim | vim | vim licen[cs]e | 30 | 0.9
tcl | tcl tk | tcl tk licen[cs]e | 30 | 0.9
qpl-1.0 | q public | q public licen[cs]e(?: version)?(?: 1 0)? | 20 | 0.9
sleepycat | sleepycat | sleepycat licen[cs]e | 20 | 0.9
ntp | university of delaware makes no representations | university of delaware makes no representations about the suitability this software | 20 | 0.9
hpnd | historical permission notice | historical permission notice and disclaimer | 20 | 0.9
hpnd | permission to use copy modify and distribute | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted | 20 | 0.8
ftl | freetype | freetype (?:project )?licen[cs]e | 20 | 0.9
ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group | 20 | 0.9
imagemagick | imagemagick | imagemagick licen[cs]e | 20 | 0.9
ogl-3.0 | open government | open government licen[cs]e(?: version| v)?(?: 3 0)? | 20 | 0.9
odbl-1.0 | opendatacommons org licenses odbl | opendatacommons org licenses odbl(?: 1 0)? | 18 | 1.0
odc-by-1.0 | opendatacommons org licenses by | opendatacommons org licenses by(?: 1 0)? | 18 | 1.0
pddl-1.0 | public domain dedication and | (?:open data commons )?public domain dedication and licen[cs]e | 18 | 0.95
cdla-permissive-2.0 | community data | community data licen[cs]e agreement permissive(?: version)? 2 0 | 18 | 0.95
cdla-sharing-1.0 | community data | community data licen[cs]e agreement sharing(?: version)? 1 0 | 18 | 0.95
ofl-1.1 | scripts sil org | scripts sil org ofl | 20 | 0.9
ubuntu-font | ubuntu font | ubuntu font licen[cs]e(?: version)?(?: 1 0)? | 20 | 0.9
sspl-1.0 | server side public | server side public licen[cs]e(?: version| v)?(?: 1)? | 18 | 0.95
busl-1.1 | business source | business source licen[cs]e(?: version)?(?: 1 1)? | 18 | 0.95
elastic-2.0 | elastic | elastic licen[cs]e(?: version| v)?(?: ?2 0)? | 30 | 0.9
commons-clause | commons clause | commons clause(?: licen[cs]e)?(?: condition)?(?: v1 0)? | 20 | 0.9
polyform-noncommercial-1.0 | polyform noncommercial | polyform noncommercial licen[cs]e(?: 1 0 0)? | 20 | 0.95
bigscience-openrail-m | openrail | (?:bigscience |creativeml )?openrail(?: m|m)?(?: licen[cs]e)? | 40 | 0.7
llama-community | llama | llama (?:2 |3 |3 1 )?community licen[cs]e(?: agreement)? | 30 | 0.9
nvidia-eula | nvidia software | nvidia software licen[cs]e(?: agreement)? | 30 | 0.8
blueoak-1.0.0 | blue oak model | blue oak model licen[cs]e(?: 1 0 0)? | 20 | 0.95
mulan-psl-2.0 | mulan permissive software | mulan permissive software licen[cs]e(?: version| v)? ?2? | 20 | 0.95
eupl | joinup ec europa eu | joinup ec europa eu (?:software|collection) (?:page )?eupl | 30 | 0.8
postgresql | in no event shall the university of california | in no event shall the university of california be liable to any party for direct indirect | 30 | 0.7
cecill-b | cecill b | cecill b(?: free software licen[cs]e agreement)? | 25 | 0.9
cecill-c | cecill c | cecill c(?: free software licen[cs]e agreement)? | 25 | 0.9
gfdl | permission is granted to copy distribute and or modify this document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license | 16 | 0.95
public-domain | in the public domain | (?:work|code|file|text|software|image) (?:is|was|are) in the public domain | 70 | 0.6
public-domain | no known copyright restrictions | no known copyright restrictions | 60 | 0.7
public-domain | dedicate any and all copyright interest | dedicate any and all copyright interest in the software to the public domain | 16 | 0.95
all-rights-reserved | copyright all rights | copyright all rights reserved | 79 | 0.4
proprietary | unauthorized copying of this file | unauthorized copying of this file via any medium is strictly prohibited | 20 | 0.95
proprietary | trade secrets | (?:contains|constitutes?) (?:the )?(?:valuable )?trade secrets | 60 | 0.6
proprietary | reproduced | may not be (?:copied or )?reproduced (?:or distributed )?(?:in any form )?without (?:the )?(?:prior )?(?:express )?written permission | 60 | 0.6
proprietary | end user | end user licen[cs]e agreement | 65 | 0.5
non-commercial | non commercial use only | (?:for )?non commercial use only | 65 | 0.6
non-commercial | personal use only | (?:for )?personal use only | 66 | 0.4
research-only | purposes only | (?:for )?(?:academic|research)(?: and educational)? purposes only | 65 | 0.6
freeware | freeware | (?:distributed|released|available) as freeware | 65 | 0.5
shareware | shareware | (?:distributed|released|available) as shareware | 65 | 0.5
"""


#: Short names and identifiers, written by hand like SIGNATURES: names of two parts stand alone, plain ones need words around
#: them. <granted> stands for GRANTED.
PLAIN_FORMS = r"""
mit | mit | <granted>(?:the )?mit | 56 | 0.7
mit | mit | mit or (?:the )?apache | 56 | 0.7
mit | mit | (?:apache 2 0|apache 2|apache|gpl|bsd|isc|zlib|unlicense|cc0 1 0) (?:or|and) mit | 56 | 0.7
mit | license mit | license mit | 60 | 0.6
mit | mit expat | mit expat(?: licen[cs]e)? | 40 | 0.8
mit-0 | mit 0 | <granted>mit 0 | 40 | 0.8
mit-modern-variant | modern mit | modern mit variant | 40 | 0.8
isc | isc | <granted>(?:the )?isc | 56 | 0.7
isc | license isc | license isc | 60 | 0.6
zlib | zlib | <granted>(?:the )?zlib | 56 | 0.7
bsd | bsd | <granted>(?:the |a )?bsd | 58 | 0.6
bsd-2-clause | bsd 2 clause | bsd 2 clause | 52 | 0.8
bsd-3-clause | bsd 3 clause | bsd 3 clause | 52 | 0.8
bsd-4-clause | bsd 4 clause | bsd 4 clause | 52 | 0.8
bsd-2-clause-patent | bsd 2 clause patent | bsd 2 clause patent | 40 | 0.9
bsd-2-clause-views | bsd 2 clause views | bsd 2 clause views | 40 | 0.9
bsd-3-clause-lbnl | bsd 3 clause lbnl | bsd 3 clause lbnl | 40 | 0.9
bsd-3-clause-attribution | bsd 3 clause attribution | bsd 3 clause attribution | 40 | 0.9
bsd-source-code | bsd source code | bsd source code attribution | 40 | 0.8
bsd-protection | bsd protection | bsd protection licen[cs]e | 40 | 0.9
0bsd | 0bsd | 0bsd | 56 | 0.8
apache-2 | apache 2 0 | apache 2 0 | 45 | 0.7
apache-2 | apache | <granted>(?:the )?apache(?: 2| v2)? | 58 | 0.6
apache-2 | apache2 | apache2(?: 0)? licen[cs]ed? | 50 | 0.7
apache-2 | license apache | license apache 2 0 | 44 | 0.8
apache-2 | apache licensed | apache licensed | 60 | 0.5
apache-1.1 | apache 1 1 | apache 1 1 | 50 | 0.6
apache-1.0 | apache 1 0 | apache 1 0 licen[cs]e | 50 | 0.7
gpl | gpl | <granted>gpl | 63 | 0.6
gpl | gnu public | gnu public licen[cs]e | 63 | 0.6
gpl-2 | gplv2 | gplv2 | 50 | 0.8
gpl-2-or-later | gplv2 | gplv2 or later | 29 | 0.9
gpl-3-or-later | gplv3 | gplv3 or later | 29 | 0.9
gpl-2-or-later | gpl 2 0 | gpl 2 0 or later | 29 | 0.9
gpl-3-or-later | gpl 3 0 | gpl 3 0 or later | 29 | 0.9
gpl-2-only | gpl 2 0 only | gpl 2 0 only | 29 | 0.9
gpl-3-only | gpl 3 0 only | gpl 3 0 only | 29 | 0.9
gpl-2 | gpl 2 0 | gpl 2 0 | 46 | 0.8
gpl-3 | gpl 3 0 | gpl 3 0 | 46 | 0.8
lgpl-2.1 | lgpl 2 1 | lgpl 2 1 | 46 | 0.8
lgpl-3 | lgpl 3 0 | lgpl 3 0 | 46 | 0.8
lgpl | lgpl | <granted>lgpl | 63 | 0.6
agpl-3 | agpl 3 0 | agpl 3 0 | 46 | 0.8
agpl | agpl | <granted>agpl | 63 | 0.6
gfdl | gfdl | <granted>(?:the )?(?:gnu )?gfdl | 63 | 0.6
gpl-2-with-font-exception | font exception | gpl(?: 2 0)? (?:only )?with font exception | 20 | 0.9
gpl-2-with-openssl-exception | openssl exception | gpl(?: 2 0)? (?:only )?with openssl exception | 20 | 0.9
llvm-exception | llvm exception | with llvm exceptions? | 20 | 0.8
mpl-2.0 | mpl 2 0 | mpl 2 0 | 46 | 0.8
mpl-1.1 | mpl 1 1 | mpl 1 1 | 46 | 0.8
mpl | mpl | <granted>(?:the )?mpl | 63 | 0.6
epl-2.0 | epl 2 0 | epl 2 0 | 46 | 0.8
epl-1.0 | epl 1 0 | epl 1 0 | 46 | 0.8
epl | epl | <granted>(?:the )?epl | 63 | 0.6
eupl-1.2 | eupl 1 2 | eupl 1 2 | 46 | 0.8
eupl-1.1 | eupl 1 1 | eupl 1 1 | 46 | 0.8
eupl | eupl | <granted>(?:the )?eupl | 63 | 0.6
cddl-1.0 | cddl 1 0 | cddl 1 0 | 46 | 0.8
cddl-1.1 | cddl 1 1 | cddl 1 1 | 46 | 0.8
cpl-1.0 | cpl 1 0 | cpl 1 0 | 46 | 0.7
bsl-1.0 | bsl 1 0 | bsl 1 0 | 46 | 0.7
busl-1.1 | busl 1 1 | busl 1 1 | 46 | 0.8
busl-1.1 | bsl 1 1 | bsl 1 1 | 46 | 0.7
osl-3.0 | osl 3 0 | osl 3 0 | 46 | 0.7
osl-2.1 | osl 2 1 | osl 2 1 | 46 | 0.7
afl-3.0 | afl 3 0 | afl 3 0 | 46 | 0.7
afl-2.1 | afl 2 1 | afl 2 1 | 46 | 0.7
ofl-1.1 | ofl 1 1 | ofl 1 1(?: no rfn| rfn)? | 46 | 0.8
odbl-1.0 | odbl 1 0 | odbl 1 0 | 46 | 0.8
odc-by-1.0 | odc by 1 0 | odc by 1 0 | 46 | 0.8
pddl-1.0 | pddl 1 0 | pddl 1 0 | 46 | 0.8
zpl-2.1 | zpl 2 1 | zpl 2 1 | 46 | 0.8
php-3.01 | php 3 01 | php 3 01 | 46 | 0.8
ecl-2.0 | ecl 2 0 | ecl 2 0 | 46 | 0.7
upl-1.0 | upl 1 0 | upl 1 0 | 46 | 0.8
ncsa | ncsa | <granted>(?:the )?ncsa | 58 | 0.6
lppl-1.3c | lppl 1 3c | lppl 1 3c | 46 | 0.8
ms-pl | ms pl | ms pl | 60 | 0.5
ms-rl | ms rl | ms rl | 60 | 0.5
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e(?: ms rl)? | 20 | 0.9
ms-lpl | microsoft limited public | microsoft limited public licen[cs]e | 20 | 0.9
mulan-psl-2.0 | mulanpsl 2 0 | mulanpsl 2 0 | 46 | 0.9
mulan-psl-1.0 | mulanpsl 1 0 | mulanpsl 1 0 | 46 | 0.9
mulan-psl-2.0 | mulan psl | mulan psl(?: v)? ?2(?: 0)? | 46 | 0.9
cc0-1.0 | license cc0 | license cc0 | 40 | 0.8
cc-by | cc by | <granted>(?:the )?cc by | 60 | 0.7
wtfpl | wtfpl | <granted>(?:the )?wtfpl | 56 | 0.8
unlicense | unlicense | <granted>(?:the )?unlicense | 40 | 0.9
artistic | artistic | <granted>(?:the )?artistic | 66 | 0.5
ruby | ruby | ruby licensed | 66 | 0.4
openssl | openssl ssleay | openssl ssleay licen[cs]e | 20 | 0.9
psf-2.0 | psf 2 0 | psf 2 0 | 46 | 0.8
python-2.0 | python 2 0 | license python 2 0 | 40 | 0.8
sspl-1.0 | sspl 1 0 | sspl 1 0 | 46 | 0.9
sspl-1.0 | sspl | <granted>(?:the )?sspl | 58 | 0.8
elastic-2.0 | elastic 2 0 | license elastic 2 0 | 40 | 0.9
w3c | w3c | license w3c | 40 | 0.8
vim | vim | license vim | 40 | 0.7
x11 | x11 | <granted>(?:the )?x11 | 58 | 0.6
hpnd | hpnd | license hpnd | 40 | 0.8
blueoak-1.0.0 | blueoak 1 0 0 | blueoak 1 0 0 | 40 | 0.9
cecill-2.1 | cecill 2 1 | cecill 2 1 | 46 | 0.8
eudatagrid | eu datagrid | eu datagrid software licen[cs]e | 20 | 0.9
gpl | gpl compatible | gpl compatible | 75 | 0.2
lgpl-2.1-or-later | lgplv2 1 | lgplv2 1 or later | 29 | 0.9
lgpl-3-or-later | lgplv3 | lgplv3 or later | 29 | 0.9
agpl-3-or-later | agplv3 | agplv3 or later | 29 | 0.9
lgpl-2.1 | lgplv2 1 | lgplv2 1 | 46 | 0.8
lgpl-3 | lgplv3 | lgplv3 | 46 | 0.8
agpl-3 | agplv3 | agplv3 | 46 | 0.8
"""

#: Sentences of license texts and of the notices that go with them, written by hand like SIGNATURES.
SENTENCES = r"""
mit | the software is provided as is without warranty | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability | 35 | 0.6
mit | in no event shall the authors or copyright holders | in no event shall the authors or copyright holders be liable for any claim damages or other liability | 35 | 0.6
isc | the software is provided as is and the author disclaims | the software is provided as is and the author disclaims all warranties with regard to this software | 35 | 0.8
bsd | this software is provided by the copyright holders and contributors | this software is provided by the copyright holders and contributors as is and any express or implied warranties | 35 | 0.7
bsd | this software is provided by the regents | this software is provided by the regents and contributors as is | 34 | 0.8
apache-2 | unless required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis | 30 | 0.8
apache-2 | grant of patent license | grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you | 25 | 0.9
apache-2 | licensed to the apache software foundation | licensed to the apache software foundation asf under one or more contributor license agreements | 25 | 0.9
apache-2 | terms and conditions for use reproduction | terms and conditions for use reproduction and distribution | 35 | 0.6
gpl | this program is free software | this program is free software you can redistribute it and or modify it | 64 | 0.6
gpl | this program is distributed in the hope | this program is distributed in the hope that it will be useful but without any warranty | 64 | 0.5
gpl | you should have received a copy of the gnu general | you should have received a copy of the gnu general public licen[cs]e along with | 64 | 0.6
gpl | everyone is permitted to copy | everyone is permitted to copy and distribute verbatim copies of this license document | 66 | 0.5
gpl | the licenses for most software | the licenses for most software (?:and other practical works )?are designed to take away your freedom | 30 | 0.8
lgpl | this library is free software | this library is free software you can redistribute it and or modify it | 63 | 0.7
lgpl | this library is distributed in the hope | this library is distributed in the hope that it will be useful | 63 | 0.6
lgpl | you should have received a copy of the gnu lesser | you should have received a copy of the gnu lesser general public licen[cs]e | 63 | 0.7
lgpl | you should have received a copy of the gnu library | you should have received a copy of the gnu library general public licen[cs]e | 63 | 0.7
lgpl | work that uses the library | a work that uses the library in isolation is not a derivative work of the library | 30 | 0.8
agpl | remote network interaction | remote network interaction use with the gnu general public license | 20 | 0.9
agpl | you should have received a copy of the gnu affero | you should have received a copy of the gnu affero general public licen[cs]e | 63 | 0.7
gfdl | invariant sections | with no invariant sections(?: no front cover texts)?(?: and no back cover texts)? | 30 | 0.8
mpl-2.0 | covered software is provided under this license | covered software is provided under this license on an as is basis | 20 | 0.9
mpl-1.1 | the contents of this file are subject to the mozilla | the contents of this file are subject to the mozilla public licen[cs]e version 1 1 | 10 | 1.0
mpl | the contents of this file are subject to the mozilla | the contents of this file are subject to the mozilla public licen[cs]e | 62 | 0.7
npl-1.1 | the contents of this file are subject to the netscape | the contents of this file are subject to the netscape public licen[cs]e | 15 | 0.9
epl | this program and the accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e | 61 | 0.7
cpl-1.0 | this program and the accompanying materials | this program and the accompanying materials are made available under the terms of the common public licen[cs]e | 15 | 0.9
cddl | the contents of this file are subject to the terms of the common | the contents of this file are subject to the terms of the common development and distribution licen[cs]e | 61 | 0.8
cc | to view a copy of this license | to view a copy of this license visit | 75 | 0.3
cc0-1.0 | the person who associated a work | the person who associated a work with this deed has dedicated the work to the public domain | 15 | 1.0
cc-by | you are free to share copy | you are free to share copy and redistribute the material in any medium or format | 65 | 0.5
cc-by-sa | if you remix transform | if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e | 50 | 0.8
cc-by-nd | if you remix transform | if you remix transform or build upon the material you may not distribute the modified material | 50 | 0.8
cc-by-nc | you may not use the material for commercial purposes | you may not use the material for commercial purposes | 50 | 0.8
wtfpl | everyone is permitted to copy and distribute verbatim or modified | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed | 15 | 0.95
unlicense | anyone is free to copy modify publish | anyone is free to copy modify publish use compile sell or distribute this software | 15 | 0.95
zlib | the origin of this software must not be misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software | 16 | 0.95
zlib | this notice may not be removed | this notice may not be removed or altered from any source distribution | 17 | 0.9
bsl-1.0 | permission is hereby granted free of charge to any person or organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license | 10 | 1.0
bsl-1.0 | boost org license | (?:www )?boost org license 1 0(?: txt)? | 18 | 1.0
openssl | redistributions of any form whatsoever | redistributions of any form whatsoever must retain the following acknowledgment | 17 | 0.9
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted | 10 | 1.0
ncsa | to deal with the software | to deal with the software without restriction including without limitation the rights to use copy modify merge | 14 | 0.9
mit-0 | permission is hereby granted free of charge to any person obtaining a copy of this software | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is | 9 | 1.0
curl | permission to use copy modify and distribute this software for any purpose with or without fee | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies | 13 | 0.8
x11 | except as contained in this notice | except as contained in this notice the name of (?:the x consortium|x consortium) shall not be used in advertising | 13 | 0.95
python-2.0 | psf is making python available | psf is making python available to licensee on an as is basis | 15 | 1.0
artistic-2.0 | this license establishes the terms | this license establishes the terms under which a given free software package may be copied modified distributed | 15 | 0.95
artistic-1.0 | the intent of this document | the intent of this document is to state the conditions under which a package may be copied | 15 | 0.95
ofl-1.1 | this font software is licensed | this font software is licensed under the sil open font licen[cs]e(?: version 1 1)? | 12 | 1.0
ofl-1.1 | the goals of the open font license | the goals of the open font license ofl are to stimulate worldwide development | 15 | 0.95
sspl-1.0 | offering the program as a service | offering the program as a service if you make the functionality of the program or a modified version available | 15 | 0.95
busl-1.1 | the licensor hereby grants you the right to copy | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use | 15 | 0.95
elastic-2.0 | you may not provide the software to third parties | you may not provide the software to third parties as a hosted or managed service | 20 | 0.9
proprietary | this software is the confidential | this software is the confidential and proprietary information of | 20 | 0.95
proprietary | no part of this | no part of this (?:publication|book|document|work|software) may be reproduced | 60 | 0.7
proprietary | for internal use only | for internal use only | 70 | 0.4
proprietary | evaluation purposes only | (?:for )?evaluation purposes only | 65 | 0.5
"""


def _written() -> list[Rule]:
    lines = [[x.strip() for x in line.split(" | ")] for part in (SIGNATURES, PLAIN_FORMS, SENTENCES) for line in part.strip().splitlines()]
    return [_rule(int(priority), label, keyword, pattern.replace("<granted>", GRANTED), float(weight)) for label, keyword, pattern, priority, weight in lines]


def _gnu() -> list[Rule]:
    names = {"gpl": "gnu general public", "lgpl": "gnu (?:lesser|library) general public", "agpl": "gnu affero general public", "gfdl": "gnu free documentation"}
    versions = {"gpl": ("1", "2", "3"), "lgpl": ("2", "2 1", "3"), "agpl": ("1", "3"), "gfdl": ("1 1", "1 2", "1 3")}
    out = []
    for short, name in names.items():
        keyword = {"gpl": "general public", "lgpl": "general public", "agpl": "affero", "gfdl": "documentation"}[short]
        for v in versions[short]:
            tag = f"{short}-{v.replace(' ', '.')}"
            v_end = rf"{v}(?: 0)?" if " " not in v else v
            out += [
                _rule(10, f"{tag}-or-later", keyword, rf"{name} licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version|v) {v_end} (?:of the licen[cs]e )?or (?:\(at your option\) |at your option )?any later(?: version)?", 1.0),
                _rule(20, tag, keyword, rf"{name} licen[cs]e (?:as published by the free software foundation )?(?:either )?(?:version|v) ?{v_end}", 0.95),
                _rule(20, tag, keyword, rf"version {v_end} of the {name} licen[cs]e", 0.95),
                _rule(30, f"{tag}-or-later", short, rf"{short} ?v? ?{v_end} or (?:any )?later", 0.9),
                _rule(31, f"{tag}-only", short, rf"{short} ?v? ?{v_end} only", 0.9),
                _rule(40, tag, short, rf"{short}(?: version | ?v ?){v_end}", 0.8),
                _rule(41, tag, short, rf"{UNDER}{short} ?{v_end}", 0.8),
                _rule(42, tag, short, rf"{short} ?{v_end} {LICENSED}", 0.8),
                _rule(25, tag, "www gnu org", rf"www gnu org licenses (?:old licenses )?{short} {v_end}(?: html| txt)?", 0.9),
            ]
        out.append(_rule(60, short, keyword, rf"{name} licen[cs]e", 0.7))
    return out


def _creative_commons() -> list[Rule]:
    kinds = {
        "by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s?(?: works)?", "by-nc": "attribution non ?commercial",
        "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?",
    }
    out = []
    for (kind, name), v in product(kinds.items(), ("1 0", "2 0", "2 5", "3 0", "4 0")):
        label, code = f"cc-{kind}-{v.replace(' ', '.')}", kind.replace("-", " ")
        length = kind.count("-")  # the longer names go first
        out += [
            _rule(20 - length, label, "creative commons", rf"creative commons {name} {v}(?: (?:international|unported|generic))?(?: public)?(?: licen[cs]e)?", 1.0),
            _rule(22 - length, label, "creativecommons org", rf"creativecommons org licenses {code} {v}", 1.0),
            _rule(24 - length, label, "cc by", rf"cc {code} {v}", 0.95),
        ]
    for kind, name in kinds.items():
        length = kind.count("-")
        out += [
            _rule(50 - length, f"cc-{kind}", "creative commons", rf"creative commons {name}(?: licen[cs]e)?", 0.8),
            _rule(54 - length, f"cc-{kind}", "cc by", rf"cc {kind.replace('-', ' ')}", 0.7),
        ]
    out += [
        _rule(20, "cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 0.9),
        _rule(20, "cc0-1.0", "creative commons", r"creative commons (?:zero|cc0)(?: v?1 0)?(?: universal)?", 0.95),
        _rule(20, "cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0", 1.0),
        _rule(70, "creative-commons", "creative commons", r"(?:licensed|available|released|distributed) under (?:a |the )?creative commons(?: licen[cs]e)?", 0.5),
    ]
    return out


def _versioned() -> list[Rule]:
    families = {
        "apache": ("apache (?:software )?licen[cs]e", "apache", ("1 0", "1 1", "2 0", "2")), "mpl": ("mozilla public licen[cs]e", "mozilla public", ("1 0", "1 1", "2 0")),
        "epl": ("eclipse public licen[cs]e", "eclipse public", ("1 0", "2 0")), "cddl": ("common development and distribution licen[cs]e", "common development", ("1 0", "1 1")),
        "cpl": ("common public licen[cs]e", "common public", ("1 0",)), "eupl": ("european union public licen[cs]e", "european union public", ("1 0", "1 1", "1 2")),
        "artistic": ("(?:the )?artistic licen[cs]e", "artistic", ("1 0", "2 0")), "bsl": ("boost software licen[cs]e", "boost software", ("1 0",)),
        "osl": ("open software licen[cs]e", "open software", ("1 0", "2 0", "2 1", "3 0")), "afl": ("academic free licen[cs]e", "academic free", ("1 2", "2 0", "2 1", "3 0")),
        "ofl": ("sil open font licen[cs]e", "open font", ("1 0", "1 1")), "odbl": ("open (?:data commons open )?database licen[cs]e", "database", ("1 0",)),
        "odc-by": ("open data commons attribution licen[cs]e", "open data commons", ("1 0",)), "zpl": ("zope public licen[cs]e", "zope public", ("1 1", "2 0", "2 1")),
        "php": ("php licen[cs]e", "php", ("3 0", "3 01")), "ecl": ("educational community licen[cs]e", "educational community", ("1 0", "2 0")),
        "cecill": ("cecill(?: free software)? licen[cs]e(?: agreement)?", "cecill", ("1 0", "2 0", "2 1")), "upl": ("universal permissive licen[cs]e", "universal permissive", ("1 0",)),
        "lppl": ("latex project public licen[cs]e", "latex project", ("1 0", "1 2", "1 3")), "ms-pl": ("microsoft public licen[cs]e", "microsoft public", ()),
    }
    out = []
    for short, (name, keyword, versions) in families.items():
        for v in versions:
            label = f"{short}-{v.replace(' ', '.')}" if (short, v) != ("apache", "2 0") else "apache-2"
            out += [
                _rule(20, label, keyword, rf"{name} (?:version |v ?)?{v}", 0.95),
                _rule(21, label, short.replace("-", " "), rf"spdx license identifier {short.replace('-', ' ')} {v}", 1.0),
                _rule(40, label, short.replace("-", " "), rf"{short.replace('-', ' ')} (?:licen[cs]e (?:version |v ?)?|version |v ?){v}", 0.7),
                _rule(41, label, short.replace("-", " "), rf"{UNDER}{short.replace('-', ' ')} {v}", 0.7),
                _rule(42, label, short.replace("-", " "), rf"{short.replace('-', ' ')} {v} {LICENSED}", 0.7),
            ]
        out.append(_rule(60, short, keyword, name, 0.6))
    return out


def _permissive() -> list[Rule]:
    out = []
    for label, names in (
        ("mit", ("mit", "expat")), ("isc", ("isc",)), ("zlib", ("zlib", "zlib libpng")), ("bsd-2-clause", ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd")),
        ("bsd-3-clause", ("bsd 3 clause", "3 clause bsd", "new bsd", "revised bsd", "modified bsd")), ("bsd-4-clause", ("bsd 4 clause", "4 clause bsd", "original bsd")),
        ("0bsd", ("0bsd", "zero clause bsd")), ("wtfpl", ("wtfpl", "do what the fuck you want to public")), ("python", ("python software foundation", "psf")),
        ("openssl", ("openssl",)), ("postgresql", ("postgresql",)), ("ncsa", ("university of illinois ncsa open source", "ncsa")), ("x11", ("x11",)), ("ruby", ("ruby",)), ("curl", ("curl",)), ("libpng", ("libpng",)),
    ):
        for name in names:
            out += [
                _rule(30, label, f"{name} license", rf"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?{name} license", 0.95),
                _rule(31, label, f"{name} licence", rf"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?{name} licence", 0.95),
                _rule(32, label, name, rf"spdx license identifier {name}", 1.0),
                _rule(55, label, name, rf"{name} (?:style )?licen[cs]e{OTHER_THING}", 0.7),
            ]
    texts = {
        "mit": ("permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
        "isc": ("permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        "bsd-3-clause": ("neither the name", r"neither the name of .{1,80}? nor the names of (?:its|any) contributors may be used to endorse"),
        "bsd": ("redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
        "zlib": ("as is without any express", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
        "unlicense": ("unencumbered software", r"this is free and unencumbered software released into the public domain"),
        "apache-2": ("apache org licenses", r"www apache org licenses license 2 0(?: txt| html)?"),
        "wtfpl": ("do what the fuck", r"do what the fuck you want to"),
        "public-domain": ("public domain", r"(?:placed|released|dedicated|is) (?:in|into|to) the public domain"),
        "all-rights-reserved": ("all rights reserved", r"all rights reserved"),
        "proprietary": ("proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    }
    out += [_rule(15 if label not in ("all-rights-reserved", "public-domain", "proprietary") else 80, label, k, p, 0.9 if label != "all-rights-reserved" else 0.4) for label, (k, p) in texts.items()]
    return out


@cache
def rules() -> list[Rule]:
    """All rules by priority; ties in the order written."""
    return sorted([*_written(), *_gnu(), *_creative_commons(), *_versioned(), *_permissive()], key=lambda r: r.priority)


#: Keywords of which the rules may go on within the word.
OPEN = {"gpl", "lgpl", "agpl", "gfdl"}


@cache
def _gate() -> tuple[ahocorasick.Automaton, list[Rule]]:
    """The automaton of all keywords, each from the beginning of a word on, the short ones to its end too."""
    ordered, gate = rules(), ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    for i, r in enumerate(ordered):
        by.setdefault(r.keyword, []).append(i)
    for k, of in by.items():
        gate.add_word(f" {k} " if len(k) <= 4 and k not in OPEN else f" {k}", of)
    gate.make_automaton()
    return gate, ordered


def tried(text: str) -> list[int]:
    """Numbers of the rules whose keyword stands in a text of words joined by spaces."""
    return sorted({i for _, of in _gate()[0].iter(f" {text} ") for i in of})


class Hit(NamedTuple):
    """A match of a rule (its number) at characters [lo, hi), in the order in which detections are taken."""

    priority: int
    shorter: int
    lo: int
    rule: int
    hi: int


def denied(text: str, lo: int) -> bool:
    return DENIED.search(text, max(0, lo - 80), lo) is not None


def matches(text: str) -> list[Hit]:
    """All matches of the rules that are tried, but those that are denied."""
    ordered = _gate()[1]
    found = [Hit(ordered[i].priority, m.start() - m.end(), m.start(), i, m.end()) for i in tried(text) for m in ordered[i].pattern.finditer(text)]
    return sorted(h for h in found if not denied(text, h.lo))


def covers(label: str, other: str) -> bool:
    """Whether a license is the other or a more exact form of it."""
    return label == other or label.startswith((f"{other}-", f"{other}."))


def resolved(hits: list[Hit]) -> list[Hit]:
    """What remains of matches in their order of taking: none lies within one taken before, nor overlaps one of its own license that was, or of a more exact form."""
    taken: list[Hit] = []
    begins: list[int] = []  # of the taken ones, those that lie within no other, by place: so their ends rise too
    ends: list[int] = []
    for h in hits:
        k = bisect_right(begins, h.lo)
        if k and ends[k - 1] >= h.hi:
            continue
        taken.append(h)
        a, b = bisect_left(begins, h.lo), bisect_right(ends, h.hi)  # those within the new one
        begins[a : max(a, b)], ends[a : max(a, b)] = [h.lo], [h.hi]
    ordered, order = _gate()[1], {h: n for n, h in enumerate(taken)}
    out, open_ones = set(taken), []
    for h in sorted(taken, key=lambda h: (h.lo, h.hi)):
        open_ones = [o for o in open_ones if o.hi > h.lo]
        for o in open_ones:
            mine, its = ordered[h.rule].label, ordered[o.rule].label
            if mine == its:
                out.discard(max(h, o, key=order.__getitem__))
            elif covers(mine, its):
                out.discard(o)
            elif covers(its, mine):
                out.discard(h)
        open_ones.append(h)
    return [h for h in taken if h in out]


def detect(words: list[bytes], joined: bytes | None = None) -> list[Found]:
    """Detections that remain, in the order of the words; positions count words, both ends included."""
    text = (b" ".join(words) if joined is None else joined).decode("utf-8", "replace")
    hits = matches(text)
    if not hits:
        return []
    starts, at = [], 0
    for w in text.split(" "):
        starts.append(at)
        at += len(w) + 1
    ordered = _gate()[1]
    found = [Found(ordered[h.rule].label, bisect_right(starts, h.lo) - 1, bisect_right(starts, h.hi - 1) - 1, ordered[h.rule].weight, h.priority) for h in resolved(hits)]
    return sorted(found, key=lambda f: (f.first, f.last, f.label))


def base_places(words: list[bytes], joined: bytes) -> list[tuple[int, str]]:
    """Starts of the base phrases, with their labels."""
    out = []
    for phrase, label in BASE.items():
        key = phrase.encode()
        if key in joined:
            parts = key.split()
            first, n = parts[0], len(parts)
            out += [(i, label) for i, w in enumerate(words) if w == first and words[i : i + n] == parts]
    return sorted(out)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License labels of each text, row by row, without a shuffle.

    docs needs doc_id and text; other columns are left out. Null or empty text has no words, no label and
    score 0. Every row gives one row, repeated rows and null doc_id included. Overlapping detections are
    resolved by priority, then length, then place, then the order of the rules; base labels always stay.
    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 less the product
    of what each remaining detection and base place leaves in doubt), detections (array of structs label,
    first, last, weight).
    """

    def run(doc_id, text):
        rows = []
        for t in text:
            words = folded_words(t)
            joined = b" ".join(words)
            base, found = base_places(words, joined), detect(words, joined)
            sure = 1.0
            for w in (*(f.weight for f in found), *(0.9 for _ in base)):
                sure *= 1.0 - min(w, 0.999)
            labels = {label for _, label in base}
            rows.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {f.label for f in found})), round(1.0 - sure, 6), [{"label": f.label, "first": f.first, "last": f.last, "weight": f.weight} for f in found]))
        return [doc_id, *map(list, zip(*rows, strict=True))]

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(columns, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,first:int,last:int,weight:double>>", as_bytes=True)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
