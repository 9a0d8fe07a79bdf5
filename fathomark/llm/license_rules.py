"""The signature rules of the license scan, one by one, each with a text that it matches and one that it doesn't.

A pattern is a regular expression over words joined by one space: A-Z lowered, punctuation gone ("GPL-2.0" is "gpl 2 0").
A line below is: label; priority (the lower goes first); confidence; keywords, of which every match holds one; pattern;
a text that matches; a text that doesn't. {under}, {licence} and {v} stand for the fragments right below.
"""

from __future__ import annotations

from dataclasses import dataclass

FRAGMENTS = {
    "under": "(?:licensed|licenced|released|distributed|published|provided|available|covered|offered|issued) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?",
    "licence": "licen[cs]e",
    "v": "(?:version |ver |v )?v?",
}


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[str, ...]
    pattern: str
    priority: int
    confidence: float


RULES = """
mit; 1; 1.0; identifier mit; spdx license identifier mit; SPDX-License-Identifier: MIT; SPDX identifiers: MIT
mit; 2; 0.95; under mit, under the mit, terms of mit, terms of the mit, conditions of mit, conditions of the mit; {under}mit(?: {licence})?; released under MIT; released with MIT
mit; 4; 0.8; mit licen; mit {licence}(?: agreement)?; The MIT License (MIT); MIT and its license
mit; 4; 0.8; x11 licen; (?:mit )?x11 {licence}; the X11 license; the X11 windows
mit; 4; 0.8; expat; (?:the )?expat {licence}; Expat licence; an expat community
mit; 2; 0.95; under expat, under the expat, of expat, of the expat; {under}expat(?: {licence})?; distributed under the Expat; distributed to an expat
mit; 3; 0.9; license mit, licence mit, licenses mit, licences mit; licen[cs]es? mit; License: MIT; a license from MIT
mit; 2; 0.95; opensource org; opensource org licen[cs]es? mit(?: {licence})?(?: html| php)?; https://opensource.org/licenses/MIT; https://opensource.org/about
mit; 2; 0.9; hereby granted free of charge; permission is hereby granted free of charge to any person obtaining a copy of this software; Permission is hereby granted, free of charge, to any person obtaining a copy of this software; Permission is granted, free of charge
mit; 5; 0.7; included in all copies or substantial portions; this permission notice shall be included in all copies or substantial portions of the software; this permission notice shall be included in all copies or substantial portions of the Software.; this notice shall be included
mit-0; 1; 1.0; identifier mit 0; spdx license identifier mit 0; SPDX-License-Identifier: MIT-0; SPDX-License-Identifier: MIT-1
mit-0; 3; 0.9; mit no attribution; mit no attribution(?: {licence})?; MIT No Attribution; MIT attribution
mit-0; 4; 0.8; mit 0; (?:{licence} mit 0|mit 0 {licence}); License: MIT-0; mit 0 points
apache-1; 4; 0.8; apache; apache(?: software)? {licence} {v}1 0; Apache License 1.0; Apache server 1.0
apache-1.1; 1; 1.0; identifier apache; spdx license identifier apache 1 1; SPDX-License-Identifier: Apache-1.1; Apache 1.1 server
apache-1.1; 4; 0.8; apache; (?:apache(?: software)? {licence} {v}1 1|apache 1 1 {licence}); Apache Software License, Version 1.1; Apache 1.1
apache-2; 1; 1.0; identifier apache; spdx license identifier apache 2 0; SPDX-License-Identifier: Apache-2.0; SPDX Apache
apache-2; 2; 0.95; apache; {under}apache(?: software)?(?: {licence})? ?{v}2(?: 0)?(?: {licence})?; distributed under the Apache 2.0; distributed with Apache 2.0
apache-2; 3; 0.9; apache; apache(?: software)? {licence} {v}2(?: 0)?; Apache License, Version 2.0; Apache license without a number
apache-2; 5; 0.6; apache 2, apache v; apache (?:v ?)?2(?: 0)?; Apache 2.0; Apache 3
apache-2; 3; 0.9; licen; {licence} apache {v}2(?: 0)?; License: Apache-2.0; licensed Apache helicopter
apache-2; 2; 0.95; apache org; apache org licen[cs]es? {licence} 2 0(?: txt| html)?; http://www.apache.org/licenses/LICENSE-2.0; http://www.apache.org/foundation
apache-2; 4; 0.8; asl 2, alv2, asf licen; (?:asl 2(?: 0)?|alv2|asf {licence} 2(?: 0)?); under ALv2; ASL interpreters
apache-2; 5; 0.7; limitations under the license; see the license for the specific language governing permissions and limitations under the license; See the License for the specific language governing permissions and limitations under the License.; see the license
bsd-2-clause; 1; 1.0; identifier bsd 2; spdx license identifier bsd 2 clause(?: patent| views)?; SPDX-License-Identifier: BSD-2-Clause; SPDX BSD
bsd-2-clause; 3; 0.85; bsd 2, bsd two; bsd (?:2|two) clause(?: {licence})?; BSD two clause; BSD two
bsd-2-clause; 3; 0.85; 2 clause bsd, two clause bsd; (?:2|two) clause bsd(?: {licence})?; the 2-clause BSD license; a two clause contract
bsd-2-clause; 3; 0.85; simplified bsd; simplified bsd(?: {licence})?; simplified BSD; simplified Chinese
bsd-2-clause; 4; 0.6; freebsd; freebsd(?: {licence})?; FreeBSD; free BSD
bsd-2-clause; 2; 0.95; opensource org; opensource org licen[cs]es? bsd 2 clause; https://opensource.org/licenses/BSD-2-Clause; https://opensource.org/licenses/
bsd-3-clause; 1; 1.0; identifier bsd 3; spdx license identifier bsd 3 clause(?: clear| lbnl| attribution)?; SPDX-License-Identifier: BSD-3-Clause; SPDX BSD 3
bsd-3-clause; 3; 0.85; bsd 3, bsd three; bsd (?:3|three) clause(?: {licence})?; BSD 3-Clause License; BSD 3 systems
bsd-3-clause; 3; 0.85; 3 clause bsd, three clause bsd; (?:3|three) clause bsd(?: {licence})?; three-clause BSD; three clauses
bsd-3-clause; 3; 0.85; new bsd, modified bsd, revised bsd; (?:new|modified|revised) bsd(?: {licence})?; published under the new BSD; a new car
bsd-3-clause; 2; 0.95; opensource org; opensource org licen[cs]es? bsd 3 clause; https://opensource.org/licenses/BSD-3-Clause; https://opensource.org/licenses/BSD
bsd-3-clause; 5; 0.7; nor the names of its contributors; neither the name of (?:the )?[a-z0-9 ]{1,60} nor the names of its contributors may be used; Neither the name of the copyright holder nor the names of its contributors may be used; Neither the name nor the contributors
bsd-4-clause; 1; 1.0; identifier bsd 4; spdx license identifier bsd 4 clause(?: uc)?; SPDX-License-Identifier: BSD-4-Clause; SPDX BSD 4
bsd-4-clause; 3; 0.85; bsd 4, bsd four; bsd (?:4|four) clause(?: {licence})?; BSD 4-clause; 4.4 BSD
bsd-4-clause; 3; 0.85; 4 clause bsd, four clause bsd; (?:4|four) clause bsd(?: {licence})?; four clause BSD licence; a four clause will
bsd-4-clause; 3; 0.85; original bsd, old bsd; (?:original|old) bsd {licence}; the original BSD license; the original idea
bsd-4-clause; 5; 0.7; all advertising materials mentioning; all advertising materials mentioning features or use of this software must display; All advertising materials mentioning features or use of this software must display the following; All advertising materials
bsd; 5; 0.6; bsd; (?:{under}bsd|bsd style {licence}|bsd {licence}); under a BSD-style license; BSD sockets
bsd; 6; 0.5; redistribution and use in source and binary; redistribution and use in source and binary forms with or without modification are permitted; Redistribution and use in source and binary forms, with or without modification, are permitted; use in source form
0bsd; 1; 1.0; identifier 0bsd; spdx license identifier 0bsd; SPDX-License-Identifier: 0BSD; 0BSD
0bsd; 3; 0.85; zero clause bsd, bsd zero clause; (?:zero clause bsd|bsd zero clause)(?: {licence})?; Zero-Clause BSD; Zero clauses
0bsd; 3; 0.85; 0bsd; (?:{under}0bsd|0bsd {licence}|{licence} 0bsd); License: 0BSD; 0bsd
gpl-1; 1; 1.0; identifier gpl 1; spdx license identifier gpl 1 0(?: only| or later)?; SPDX-License-Identifier: GPL-1.0-only; GPL 1
gpl-1; 3; 0.85; general public licen, gpl; (?:gnu )?(?:general public {licence}|gpl) ?{v}v?1(?: 0)?; GNU General Public License version 1; GNU General Public License
gpl-2; 1; 1.0; identifier gpl 2; spdx license identifier gpl 2 0(?: only| or later)?(?: with [a-z ]{3,40} exception)?; SPDX-License-Identifier: GPL-2.0-or-later; SPDX GPL
gpl-2; 2; 0.95; gpl; {under}(?:gnu )?gpl ?{v}v?2(?: 0)?(?: {licence})?; released under the GNU GPL v2; released under the GPL
gpl-2; 2; 0.95; general public licen; {under}(?:gnu )?general public {licence} ?{v}2(?: 0)?; licensed under the General Public License, version 2; the general public
gpl-2; 3; 0.85; general public licen; (?:gnu )?general public {licence} ?{v}2(?: 0)?; GNU General Public License v2; GNU General Public License
gpl-2; 4; 0.75; gpl; (?:gnu )?gpl ?{v}v?2(?: 0)?(?: only| or later)?; GPL-2.0; GPL 4
gpl-2; 4; 0.75; gplv2; gplv2(?: or later)?; GPLv2+; GPLv
gpl-2; 4; 0.8; either version 2 of the; either version 2 of the {licence} or at your option any later version; either version 2 of the License, or (at your option) any later version; either version of the license
gpl-3; 1; 1.0; identifier gpl 3; spdx license identifier gpl 3 0(?: only| or later)?; SPDX-License-Identifier: GPL-3.0-only; SPDX GPL
gpl-3; 2; 0.95; gpl; {under}(?:gnu )?gpl ?{v}v?3(?: 0)?(?: {licence})?; available under GPL 3.0; available GPL
gpl-3; 2; 0.95; general public licen; {under}(?:gnu )?general public {licence} ?{v}3(?: 0)?; released under the terms of the GNU General Public License v3; the general public
gpl-3; 3; 0.85; general public licen; (?:gnu )?general public {licence} ?{v}3(?: 0)?; GNU General Public License, version 3; General Public License
gpl-3; 4; 0.75; gpl; (?:gnu )?gpl ?{v}v?3(?: 0)?(?: only| or later)?; GPL version 3; GPL 5
gpl-3; 4; 0.75; gplv3; gplv3(?: or later)?; GPLv3+; GPLv
gpl-3; 4; 0.8; either version 3 of the; either version 3 of the {licence} or at your option any later version; either version 3 of the License, or (at your option) any later version; version 3 of the book
gpl-3; 2; 0.95; gnu org; gnu org licen[cs]es? gpl 3 0(?: en)?(?: html| txt)?; https://www.gnu.org/licenses/gpl-3.0.en.html; https://www.gnu.org/
gpl-2; 2; 0.95; gnu org; gnu org licen[cs]es? (?:old licenses )?gpl 2 0(?: en)?(?: html| txt)?; https://www.gnu.org/licenses/old-licenses/gpl-2.0.html; https://www.gnu.org/philosophy
gpl; 6; 0.5; general public licen; gnu general public {licence}; the GNU General Public License; the general public
gpl; 6; 0.5; gpl; (?:{under}(?:gnu )?gpl|gnu gpl|gpl {licence}); under the GNU GPL; gpl
lgpl-2; 1; 1.0; identifier lgpl 2 0; spdx license identifier lgpl 2 0(?: only| or later)?; SPDX-License-Identifier: LGPL-2.0-only; LGPL
lgpl-2; 3; 0.85; library general public; (?:gnu )?library general public {licence} ?{v}2(?: 0)?; GNU Library General Public License version 2; the general library
lgpl-2.1; 1; 1.0; identifier lgpl 2 1; spdx license identifier lgpl 2 1(?: only| or later)?; SPDX-License-Identifier: LGPL-2.1-or-later; LGPL 2.1
lgpl-2.1; 3; 0.85; lesser general public; (?:gnu )?lesser general public {licence} ?{v}2 1; GNU Lesser General Public License v2.1; the lesser general
lgpl-2.1; 4; 0.75; lgpl; lgpl ?{v}v?2 1(?: only| or later)?; LGPL v2.1; LGPL 2
lgpl-2.1; 2; 0.95; gnu org; gnu org licen[cs]es? (?:old licenses )?lgpl 2 1(?: en)?(?: html| txt)?; http://www.gnu.org/licenses/lgpl-2.1.html; http://www.gnu.org/lgpl
lgpl-3; 1; 1.0; identifier lgpl 3; spdx license identifier lgpl 3 0(?: only| or later)?; SPDX-License-Identifier: LGPL-3.0-only; LGPL 3
lgpl-3; 3; 0.85; lesser general public; (?:gnu )?lesser general public {licence} ?{v}3(?: 0)?; GNU Lesser General Public License, version 3; lesser general
lgpl-3; 4; 0.75; lgpl; lgpl ?{v}v?3(?: 0)?(?: only| or later)?; LGPL 3.0; LGPL 4
lgpl-3; 4; 0.75; lgplv3; lgplv3; LGPLv3; LGPLv4
lgpl; 6; 0.5; lesser general public, library general public; (?:gnu )?(?:lesser|library) general public {licence}; the GNU Lesser General Public License; lesser general officers
lgpl; 6; 0.5; lgpl; (?:{under}(?:gnu )?lgpl|gnu lgpl|lgpl {licence}); licensed under the LGPL; lgpl
agpl-3; 1; 1.0; identifier agpl 3; spdx license identifier agpl 3 0(?: only| or later)?; SPDX-License-Identifier: AGPL-3.0-or-later; AGPL
agpl-3; 3; 0.85; affero general public; (?:gnu )?affero general public {licence} ?{v}3(?: 0)?; GNU Affero General Public License v3.0; Affero
agpl-3; 4; 0.75; agpl; agpl ?{v}v?3(?: 0)?(?: only| or later)?; AGPL-3.0; AGPL 1
agpl-3; 4; 0.75; agplv3; agplv3; AGPLv3; AGPLv1
agpl-1; 4; 0.8; affero general public; affero general public {licence} ?{v}1(?: 0)?; Affero General Public License version 1; Affero 1
agpl; 6; 0.5; affero general public; (?:gnu )?affero general public {licence}; the GNU Affero General Public License; general Affero
agpl; 6; 0.5; agpl; (?:{under}(?:gnu )?agpl|agpl {licence}); covered under the AGPL; agpl
mpl-1.0; 4; 0.8; mozilla public licen, mpl; (?:mozilla public {licence}|mpl) ?{v}1 0; Mozilla Public License 1.0; Mozilla 1.0
mpl-1.1; 1; 1.0; identifier mpl 1 1; spdx license identifier mpl 1 1; SPDX-License-Identifier: MPL-1.1; MPL
mpl-1.1; 3; 0.85; mozilla public licen; mozilla public {licence} ?{v}1 1; Mozilla Public License Version 1.1; Mozilla Public
mpl-1.1; 4; 0.7; mpl; mpl ?{v}1 1; MPL 1.1; MPL 11
mpl-2; 1; 1.0; identifier mpl 2; spdx license identifier mpl 2 0(?: no copyleft exception)?; SPDX-License-Identifier: MPL-2.0; MPL
mpl-2; 3; 0.85; mozilla public licen; mozilla public {licence} ?{v}2(?: 0)?; Mozilla Public License, v. 2.0; Mozilla Public License
mpl-2; 4; 0.7; mpl; mpl ?{v}v?2(?: 0)?; MPL v2.0; MPL 3
mpl-2; 2; 0.95; mozilla org; mozilla org (?:en us )?mpl 2 0; https://mozilla.org/MPL/2.0/; https://mozilla.org/firefox
mpl; 6; 0.5; mozilla public licen; mozilla public {licence}; the Mozilla Public License; the Mozilla public
epl-1; 1; 1.0; identifier epl 1; spdx license identifier epl 1 0; SPDX-License-Identifier: EPL-1.0; EPL
epl-1; 3; 0.85; eclipse public licen; eclipse public {licence} ?{v}1(?: 0)?; Eclipse Public License v1.0; Eclipse 1.0
epl-1; 4; 0.7; epl 1, epl v; epl {v}v?1(?: 0)?; EPL 1.0; EPL one
epl-2; 1; 1.0; identifier epl 2; spdx license identifier epl 2 0; SPDX-License-Identifier: EPL-2.0; EPL
epl-2; 3; 0.85; eclipse public licen; eclipse public {licence} ?{v}2(?: 0)?; Eclipse Public License 2.0; eclipse in public
epl-2; 4; 0.7; epl 2, epl v; epl {v}v?2(?: 0)?; Available under the EPL 2.0; EPL season
epl-2; 2; 0.95; eclipse org; eclipse org legal epl (?:2 0|v20)(?: html)?; https://www.eclipse.org/legal/epl-2.0/; https://www.eclipse.org/
epl-1; 2; 0.95; eclipse org; eclipse org legal epl (?:1 0|v10)(?: html)?; http://www.eclipse.org/legal/epl-v10.html; http://www.eclipse.org/org
eupl-1.1; 3; 0.85; eupl, european union public; (?:eupl|european union public {licence}) ?{v}1 1; EUPL 1.1; European Union 1.1
eupl-1.2; 1; 1.0; identifier eupl; spdx license identifier eupl 1 2; SPDX-License-Identifier: EUPL-1.2; EUPL
eupl-1.2; 3; 0.85; eupl, european union public; (?:eupl|european union public {licence}) ?{v}1 2; European Union Public Licence v1.2; European Union
cddl-1; 1; 1.0; identifier cddl; spdx license identifier cddl 1 0; SPDX-License-Identifier: CDDL-1.0; CDDL
cddl-1; 3; 0.85; common development and distribution; common development and distribution {licence}(?: {v}1(?: 0)?)?; Common Development and Distribution License 1.0; common development
cddl-1; 4; 0.7; cddl; (?:cddl {v}1(?: 0)?|{under}cddl|cddl {licence}); under the CDDL license; cddl
cddl-1.1; 3; 0.85; cddl 1 1, distribution licen; (?:cddl 1 1|common development and distribution {licence} {v}1 1); CDDL-1.1; CDDL 2.1
cpl-1; 1; 1.0; identifier cpl; spdx license identifier cpl 1 0; SPDX-License-Identifier: CPL-1.0; CPL
cpl-1; 3; 0.85; common public licen; common public {licence}(?: {v}1(?: 0)?)?; Common Public License Version 1.0; common public
ipl-1; 3; 0.85; ibm public licen; ibm public {licence}(?: {v}1(?: 0)?)?; IBM Public License 1.0; IBM is public
isc; 1; 1.0; identifier isc; spdx license identifier isc; SPDX-License-Identifier: ISC; SPDX ISC
isc; 2; 0.95; isc; {under}isc(?: {licence}| terms)?; distributed under ISC terms; distributed by ISC
isc; 4; 0.8; isc licen; isc {licence}; the ISC license; the ISC
isc; 3; 0.9; isc; {licence} isc; License: ISC; lice isc
isc; 5; 0.7; to use copy modify and or distribute this software; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted; Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted; permission to use this
zlib; 1; 1.0; identifier zlib; spdx license identifier zlib; SPDX-License-Identifier: Zlib; zlib
zlib; 2; 0.95; zlib; {under}zlib(?: libpng)?(?: {licence})?; covered under zlib; covered by zlib
zlib; 4; 0.8; zlib licen, zlib libpng; zlib (?:libpng )?{licence}; the zlib/libpng license; the zlib library
zlib; 3; 0.9; zlib; {licence} zlib; License: zlib; zlib is licensed
zlib; 5; 0.7; altered source versions must be plainly; altered source versions must be plainly marked as such; Altered source versions must be plainly marked as such; altered versions
libpng; 3; 0.8; libpng licen, png reference library licen; (?:libpng|png reference library) {licence}; libpng license; libpng
unlicense; 1; 1.0; identifier unlicense; spdx license identifier unlicense; SPDX-License-Identifier: Unlicense; unlicense
unlicense; 2; 0.9; unlicen; (?:{under}unlicen[cs]e|{licence} unlicen[cs]e|the unlicen[cs]e); released under the Unlicense; unlicensed driver
unlicense; 2; 0.95; unlicense org; unlicense org; see https://unlicense.org; see unlicense
unlicense; 5; 0.7; released into the public domain; this is free and unencumbered software released into the public domain; This is free and unencumbered software released into the public domain. Anyone is free; free software
unlicense; 4; 0.8; free and unencumbered software; free and unencumbered software; free and unencumbered software; unencumbered land
wtfpl; 1; 1.0; identifier wtfpl; spdx license identifier wtfpl; SPDX-License-Identifier: WTFPL; WTF
wtfpl; 2; 0.9; wtfpl; (?:{under}wtfpl|wtfpl(?: {licence})?); WTFPL; WTF PL
wtfpl; 2; 0.95; what the fuck you want to public; do what the fuck you want to public {licence}; Do What The Fuck You Want To Public License; do what you want
boost-1; 1; 1.0; identifier bsl; spdx license identifier bsl 1 0; SPDX-License-Identifier: BSL-1.0; BSL
boost-1; 3; 0.85; boost software licen; boost software {licence}(?: {v}1(?: 0)?)?; Boost Software License - Version 1.0; boost software sales
boost-1; 2; 0.95; boost org; boost org license 1 0(?: txt)?; http://www.boost.org/LICENSE_1_0.txt; http://www.boost.org/doc
busl-1.1; 1; 1.0; identifier busl; spdx license identifier busl 1 1; SPDX-License-Identifier: BUSL-1.1; BUSL
busl-1.1; 3; 0.85; business source licen; business source {licence}(?: {v}1 1)?; Business Source License 1.1; business sources
artistic-1; 1; 1.0; identifier artistic 1; spdx license identifier artistic 1 0(?: perl| cl8)?; SPDX-License-Identifier: Artistic-1.0-Perl; Artistic 1
artistic-1; 3; 0.85; artistic licen; artistic {licence} {v}1(?: 0)?; Artistic License 1.0; artistic freedom
artistic-2; 1; 1.0; identifier artistic 2; spdx license identifier artistic 2 0; SPDX-License-Identifier: Artistic-2.0; Artistic 2
artistic-2; 3; 0.85; artistic licen; artistic {licence} {v}2(?: 0)?; Artistic License 2.0; artistic licence alone
artistic; 6; 0.4; perl artistic, clarified artistic; (?:perl|clarified) artistic {licence}; the Perl Artistic License; Perl artistry
python-2; 1; 1.0; identifier python, identifier psf; spdx license identifier (?:python|psf) 2 0(?: 1)?; SPDX-License-Identifier: PSF-2.0; Python 2.0
python-2; 3; 0.85; python software foundation licen, psf licen; (?:python software foundation|psf) {licence}(?: agreement)?(?: {v}2(?: 0)?)?; Python Software Foundation License version 2; Python Software Foundation
postgresql; 1; 1.0; identifier postgresql; spdx license identifier postgresql; SPDX-License-Identifier: PostgreSQL; PostgreSQL
postgresql; 2; 0.9; postgresql; {under}postgresql(?: {licence})?; provided under the terms of PostgreSQL; provided by PostgreSQL
postgresql; 4; 0.8; postgresql licen; postgresql {licence}; The PostgreSQL Licence; PostgreSQL server
openssl; 1; 1.0; identifier openssl; spdx license identifier openssl(?: standalone)?; SPDX-License-Identifier: OpenSSL; OpenSSL
openssl; 4; 0.8; openssl; (?:{under}openssl|openssl {licence}); the OpenSSL license; OpenSSL library
ssleay; 4; 0.8; ssleay licen; (?:original )?ssleay {licence}; Original SSLeay License; SSLeay
php-3; 1; 1.0; identifier php; spdx license identifier php 3 0[01]?; SPDX-License-Identifier: PHP-3.01; PHP 3
php-3; 3; 0.85; php licen; php {licence}(?: {v}3(?: 0[01]?)?)?; PHP License version 3.01; PHP code
ruby; 1; 1.0; identifier ruby; spdx license identifier ruby; SPDX-License-Identifier: Ruby; Ruby
ruby; 4; 0.75; ruby licen, ruby s licen, under ruby, under the ruby, terms of ruby, terms of the ruby, conditions of ruby, conditions of the ruby; (?:{under}ruby(?: {licence})?|ruby (?:s )?{licence}); under Ruby's license; ruby rings
ofl-1.1; 1; 1.0; identifier ofl; spdx license identifier ofl 1 [01](?: rfn| no rfn)?; SPDX-License-Identifier: OFL-1.1; OFL
ofl-1.1; 3; 0.85; open font licen; (?:sil )?open font {licence}(?: {v}1 [01])?; SIL Open Font License, Version 1.1; an open font
ofl-1.1; 4; 0.75; ofl; (?:sil ofl|ofl {v}1 1|{under}ofl); SIL OFL 1.1; OFL games
ncsa; 1; 1.0; identifier ncsa; spdx license identifier ncsa; SPDX-License-Identifier: NCSA; NCSA
ncsa; 3; 0.85; ncsa open source licen, ncsa licen; (?:university of illinois )?ncsa (?:open source )?{licence}; University of Illinois/NCSA Open Source License; University of Illinois
ms-pl; 1; 1.0; identifier ms pl; spdx license identifier ms pl; SPDX-License-Identifier: MS-PL; MS PL
ms-pl; 3; 0.85; microsoft public licen; microsoft public {licence}(?: ms pl)?; Microsoft Public License (Ms-PL); Microsoft goes public
ms-rl; 1; 1.0; identifier ms rl; spdx license identifier ms rl; SPDX-License-Identifier: MS-RL; MS RL
ms-rl; 3; 0.85; microsoft reciprocal licen; microsoft reciprocal {licence}(?: ms rl)?; Microsoft Reciprocal License; Microsoft is reciprocal
cc0; 1; 1.0; identifier cc0; spdx license identifier cc0 1 0; SPDX-License-Identifier: CC0-1.0; CC0
cc0; 3; 0.85; cc0; cc0(?: 1 0)?(?: universal)?(?: {licence}| public domain dedication)?; CC0 1.0 Universal; CC1
cc0; 3; 0.85; creative commons zero; creative commons zero(?: {v}1 0)?(?: universal)?(?: {licence})?; Creative Commons Zero v1.0 Universal; creative commons
cc0; 2; 0.95; publicdomain zero; creativecommons org publicdomain zero 1 0(?: legalcode)?; https://creativecommons.org/publicdomain/zero/1.0/; publicdomain mark
cc-pdm; 2; 0.95; publicdomain mark; creativecommons org publicdomain mark 1 0; https://creativecommons.org/publicdomain/mark/1.0/; the public mark
cc-by; 1; 1.0; identifier cc by; spdx license identifier cc by [1-4] [05]; SPDX-License-Identifier: CC-BY-4.0; CC by
cc-by; 4; 0.75; cc by; cc by(?: [1-4] [05])?(?: international| unported)?(?: {licence})?; CC BY 4.0; cc to
cc-by; 3; 0.85; creative commons attribution; creative commons attribution(?: {licence})?(?: [1-4] [05])?(?: international| unported| generic)?(?: {licence})?; Creative Commons Attribution 4.0 International; creative commons
cc-by; 2; 0.95; licenses by; creativecommons org licenses by(?: [1-4] [05])?; https://creativecommons.org/licenses/by/4.0/; https://creativecommons.org/about
cc-by-sa; 1; 1.0; identifier cc by sa; spdx license identifier cc by sa [1-4] [05]; SPDX-License-Identifier: CC-BY-SA-4.0; CC-BY
cc-by-sa; 3; 0.8; cc by sa; cc by sa(?: [1-4] [05])?(?: international| unported)?(?: {licence})?; CC BY-SA 3.0; CC BY
cc-by-sa; 3; 0.85; attribution share; (?:creative commons )?attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: {licence})?; Creative Commons Attribution-ShareAlike 4.0; share and attribution
cc-by-sa; 2; 0.95; licenses by sa; creativecommons org licenses by sa(?: [1-4] [05])?; https://creativecommons.org/licenses/by-sa/4.0/; https://creativecommons.org/licenses/by/4.0/
cc-by-nd; 1; 1.0; identifier cc by nd; spdx license identifier cc by nd [1-4] [05]; SPDX-License-Identifier: CC-BY-ND-4.0; CC-BY
cc-by-nd; 3; 0.8; cc by nd; cc by nd(?: [1-4] [05])?(?: international| unported)?(?: {licence})?; CC BY-ND; CC BY
cc-by-nd; 3; 0.85; attribution no; (?:creative commons )?attribution no ?deriv(?:ative)?(?:s| works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: {licence})?; Attribution-NoDerivatives 4.0 International; no attribution
cc-by-nd; 2; 0.95; licenses by nd; creativecommons org licenses by nd(?: [1-4] [05])?; https://creativecommons.org/licenses/by-nd/4.0/; licenses by
cc-by-nc; 1; 1.0; identifier cc by nc; spdx license identifier cc by nc [1-4] [05]; SPDX-License-Identifier: CC-BY-NC-4.0; CC-BY
cc-by-nc; 3; 0.8; cc by nc; cc by nc(?: [1-4] [05])?(?: international| unported)?(?: {licence})?; CC BY-NC 4.0; CC BY
cc-by-nc; 3; 0.85; attribution non; (?:creative commons )?attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: {licence})?; Creative Commons Attribution-NonCommercial 4.0 International; attribution, non-existent
cc-by-nc; 2; 0.95; licenses by nc; creativecommons org licenses by nc(?: [1-4] [05])?; https://creativecommons.org/licenses/by-nc/4.0/; licenses by
cc-by-nc-sa; 1; 1.0; identifier cc by nc sa; spdx license identifier cc by nc sa [1-4] [05]; SPDX-License-Identifier: CC-BY-NC-SA-4.0; CC-BY-NC
cc-by-nc-sa; 3; 0.8; cc by nc sa; cc by nc sa(?: [1-4] [05])?(?: international| unported)?(?: {licence})?; CC BY-NC-SA 4.0; CC BY-NC
cc-by-nc-sa; 3; 0.85; attribution non; (?:creative commons )?attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: {licence})?; Attribution-NonCommercial-ShareAlike 4.0; Attribution-NonCommercial
cc-by-nc-sa; 2; 0.95; licenses by nc sa; creativecommons org licenses by nc sa(?: [1-4] [05])?; https://creativecommons.org/licenses/by-nc-sa/4.0/; licenses by nc
cc-by-nc-nd; 1; 1.0; identifier cc by nc nd; spdx license identifier cc by nc nd [1-4] [05]; SPDX-License-Identifier: CC-BY-NC-ND-4.0; CC-BY-NC
cc-by-nc-nd; 3; 0.8; cc by nc nd; cc by nc nd(?: [1-4] [05])?(?: international| unported)?(?: {licence})?; CC BY-NC-ND 4.0; CC BY-NC
cc-by-nc-nd; 3; 0.85; attribution non; (?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?(?:s| works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: {licence})?; Attribution-NonCommercial-NoDerivatives 4.0; Attribution-NonCommercial
cc-by-nc-nd; 2; 0.95; licenses by nc nd; creativecommons org licenses by nc nd(?: [1-4] [05])?; https://creativecommons.org/licenses/by-nc-nd/4.0/; licenses by nc
cc; 6; 0.4; creative commons licen; (?:under )?(?:a )?creative commons {licence}; under a Creative Commons license; creative people
gfdl-1.1; 3; 0.85; gfdl 1 1, free documentation licen; (?:gfdl 1 1|(?:gnu )?free documentation {licence} {v}1 1); GNU Free Documentation License 1.1; free documentation
gfdl-1.2; 3; 0.85; gfdl 1 2, free documentation licen; (?:gfdl 1 2|(?:gnu )?free documentation {licence} {v}1 2); GNU Free Documentation License, Version 1.2; documentation 1.2
gfdl-1.3; 1; 1.0; identifier gfdl 1 3; spdx license identifier gfdl 1 3(?: only| or later)?; SPDX-License-Identifier: GFDL-1.3-or-later; GFDL
gfdl-1.3; 3; 0.85; gfdl 1 3, free documentation licen; (?:gfdl 1 3|(?:gnu )?free documentation {licence} {v}1 3); GNU Free Documentation License, Version 1.3; free documentation
gfdl; 6; 0.5; free documentation licen, gnu fdl, gfdl; (?:gnu free documentation {licence}|gnu fdl|gfdl); under the GFDL; free documentation
odbl-1; 1; 1.0; identifier odbl; spdx license identifier odbl 1 0; SPDX-License-Identifier: ODbL-1.0; ODBL
odbl-1; 3; 0.85; database licen; (?:open data commons )?open database {licence}(?: odbl)?(?: {v}1(?: 0)?)?; Open Database License (ODbL) v1.0; open databases
odbl-1; 2; 0.95; opendatacommons org; opendatacommons org licen[cs]es? odbl(?: 1 0)?; https://opendatacommons.org/licenses/odbl/; https://opendatacommons.org/
odc-by; 3; 0.85; open data commons attribution, odc by; (?:open data commons attribution {licence}|odc by(?: 1 0)?); Open Data Commons Attribution License; open data commons
pddl; 3; 0.85; public domain dedication and licen; public domain dedication and {licence}; Public Domain Dedication and License (PDDL); public domain dedications
osl-3; 1; 1.0; identifier osl; spdx license identifier osl 3 0; SPDX-License-Identifier: OSL-3.0; OSL
osl-3; 3; 0.85; open software licen; open software {licence}(?: {v}3(?: 0)?)?; Open Software License 3.0; open software
afl-3; 1; 1.0; identifier afl; spdx license identifier afl 3 0; SPDX-License-Identifier: AFL-3.0; AFL
afl-3; 3; 0.85; academic free licen; academic free {licence}(?: {v}3(?: 0)?)?; Academic Free License version 3.0; academic freedom
upl-1; 1; 1.0; identifier upl; spdx license identifier upl 1 0; SPDX-License-Identifier: UPL-1.0; UPL
upl-1; 3; 0.85; universal permissive licen; universal permissive {licence}(?: upl)?(?: {v}1(?: 0)?)?; Universal Permissive License v 1.0; universally permissive
vim; 3; 0.8; vim licen; vim {licence}; the Vim License; the vim editor
x11-distribute; 5; 0.6; shall not be used in advertising or otherwise; except as contained in this notice the names? of [a-z0-9 ]{1,60} shall not be used in advertising or otherwise; Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise; in this notice
beerware; 2; 0.9; beer ware, beerware; (?:the )?beer ?ware {licence}; THE BEER-WARE LICENSE; beer, ware
json; 3; 0.8; used for good not evil; the software shall be used for good not evil; The Software shall be used for Good, not Evil.; good and evil
curl; 1; 1.0; identifier curl; spdx license identifier curl; SPDX-License-Identifier: curl; curl
curl; 4; 0.7; curl licen; curl {licence}; the curl license; curl command
icu; 4; 0.75; icu licen; icu {licence}; ICU License; ICU ward
unicode; 3; 0.8; unicode licen, unicode inc licen; unicode (?:inc )?{licence}(?: agreement)?(?: v3| data files and software)?; Unicode License v3; Unicode text
w3c; 3; 0.8; w3c software; w3c software (?:notice and )?(?:and document )?(?:notice and )?{licence}; W3C Software Notice and License; W3C software
sspl-1; 1; 1.0; identifier sspl; spdx license identifier sspl 1 0; SPDX-License-Identifier: SSPL-1.0; SSPL
sspl-1; 3; 0.85; server side public licen; server side public {licence}(?: {v}1(?: 0)?)?; Server Side Public License, version 1; on the server side
elastic-2; 3; 0.85; elastic licen; elastic {licence}(?: {v}2(?: 0)?)?; Elastic License 2.0; elastic bands
commons-clause; 3; 0.85; commons clause; commons clause(?: {licence})?(?: condition)?(?: {v}1 0)?; Commons Clause License Condition v1.0; common clauses
cecill-2.1; 3; 0.85; cecill; (?:spdx license identifier )?cecill (?:free software {licence} agreement )?{v}2 1; CeCILL 2.1; CeCILL 3.1
cecill; 6; 0.5; cecill; cecill(?: [bc])?(?: {licence})?; the CeCILL-B licence; Cecille
zpl-2.1; 3; 0.85; zope public licen, zpl; (?:zope public {licence}|zpl) ?{v}2 1; Zope Public License (ZPL) Version 2.1 is the Zope Public License 2.1; Zope 2.1
mulan-2; 3; 0.85; mulan; mulan (?:permissive software {licence}|psl)(?: ?{v}2)?; Mulan PSL v2; Mulan the film
lppl-1.3; 3; 0.85; latex project public licen, lppl; (?:latex project public {licence}|lppl)(?: ?{v}1 3[abc]?)?; LaTeX Project Public License, version 1.3c; a LaTeX project
bitstream-vera; 3; 0.8; bitstream vera; bitstream vera (?:fonts? )?(?:copyright|{licence}); Bitstream Vera Fonts Copyright; Bitstream Vera Sans
sleepycat; 3; 0.85; sleepycat; (?:the )?sleepycat {licence}; The Sleepycat License; a sleepy cat
apsl-2; 3; 0.85; apple public source licen, apsl; (?:apple public source {licence}|apsl)(?: ?{v}2(?: 0)?)?; Apple Public Source License 2.0; apple sources
qpl-1; 3; 0.85; q public licen; q public {licence}(?: ?{v}1(?: 0)?)?; the Q Public License 1.0; a public licence
cpal-1; 3; 0.85; common public attribution licen; common public attribution {licence}(?: ?{v}1(?: 0)?)?; Common Public Attribution License Version 1.0; common attribution
cpol; 3; 0.85; code project open licen; (?:the )?code project open {licence}(?: cpol)?(?: 1 02)?; The Code Project Open License (CPOL); a code project
hpnd; 3; 0.8; historical permission notice; historical permission notice and disclaimer; Historical Permission Notice and Disclaimer; historical notices
fair; 3; 0.7; identifier fair; spdx license identifier fair; SPDX-License-Identifier: Fair; fair license fees
apache-2-llvm; 2; 0.95; llvm exception; apache(?: {licence} {v})? ?2 0 with llvm exceptions?; Apache-2.0 WITH LLVM-exception; an exception of LLVM
gpl-2-classpath; 2; 0.9; classpath exception; (?:gpl|general public {licence})(?: ?{v}2(?: 0)?)?(?: only| or later)? with (?:the )?classpath exception(?: 2 0)?; GPL-2.0-only WITH Classpath-exception-2.0; the classpath
gpl-3-gcc; 2; 0.9; gcc exception, gcc runtime library exception; (?:gpl|general public {licence})(?: ?{v}3(?: 0)?)?(?: only| or later)? with (?:the )?gcc (?:runtime library )?exception(?: 3 1)?; GPL-3.0-or-later WITH GCC-exception-3.1; GCC exceptions
blueoak-1; 3; 0.85; blue oak model licen, identifier blueoak; (?:blue oak model {licence}(?: 1 0 0)?|spdx license identifier blueoak 1 0 0); Blue Oak Model License 1.0.0; a blue oak
polyform; 3; 0.85; polyform; polyform (?:noncommercial|small business|strict|shield|perimeter|internal use)(?: {licence})?(?: 1 0 0)?; PolyForm Noncommercial License 1.0.0; polyform shapes
openrail; 3; 0.8; openrail; (?:creativeml |bigscience |bigcode )?openrail(?: m| rail m)?(?: {licence})?; CreativeML OpenRAIL-M license; open rails
llama; 3; 0.8; llama; llama (?:[23] )?(?:[123] )?community {licence}(?: agreement)?; Llama 2 Community License Agreement; a llama community
parity; 3; 0.8; parity public licen; parity public {licence}(?: 7 0 0)?; The Parity Public License 7.0.0; parity of licences
rpl-1.5; 3; 0.85; reciprocal public licen; reciprocal public {licence}(?: ?{v}1 5)?; Reciprocal Public License 1.5; reciprocal licences
watcom-1; 3; 0.85; watcom public licen; sybase open watcom public {licence}(?: {v}1(?: 0)?)?; Sybase Open Watcom Public License version 1.0; Watcom compilers
nasa-1.3; 3; 0.85; nasa open source agreement; nasa open source agreement(?: {v}1 3)?; NASA Open Source Agreement 1.3; NASA agreements
spl-1; 3; 0.85; sun public licen; sun public {licence}(?: {v}1(?: 0)?)?; Sun Public License v1.0; the sun in public
public-domain; 5; 0.6; public domain; (?:in|into|to) the public domain; released into the public domain; a public domain
public-domain; 5; 0.6; public domain; (?:this (?:work|file|software|code)|it) is public domain; this file is public domain; the domain is public
all-rights-reserved; 5; 0.6; rights reserved; all rights reserved; All rights reserved.; some rights reserved
proprietary; 4; 0.7; proprietary; (?:proprietary and confidential|confidential and proprietary); Proprietary and confidential; proprietary format
proprietary; 1; 0.9; identifier licenseref proprietary; spdx license identifier licenseref proprietary; SPDX-License-Identifier: LicenseRef-Proprietary; proprietary
proprietary; 5; 0.6; unauthorized copying; unauthorized copying of this (?:file|software) (?:via any medium )?is strictly prohibited; Unauthorized copying of this file, via any medium, is strictly prohibited; copying is prohibited
no-license; 6; 0.4; not licensed for; not licensed for (?:redistribution|commercial use|resale); not licensed for redistribution; licensed for redistribution
non-commercial; 6; 0.5; non commercial use only, noncommercial use only; (?:for )?(?:personal )?(?:and )?non ?commercial use only; for personal and non-commercial use only; commercial use
"""


def signature_rules() -> tuple[Rule, ...]:
    return tuple(r for r, _, _ in with_examples())


def with_examples() -> list[tuple[Rule, str, str]]:
    """Each rule with a text that it matches and one that it doesn't."""
    out = []
    for line in RULES.strip().splitlines():
        label, priority, confidence, keywords, pattern, yes, no = line.split("; ")
        for name, fragment in FRAGMENTS.items():
            pattern = pattern.replace("{" + name + "}", fragment)
        out.append((Rule(label, tuple(keywords.split(", ")), pattern, int(priority), float(confidence)), yes, no))
    return out
