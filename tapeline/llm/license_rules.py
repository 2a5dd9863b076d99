"""Signature rules of license texts, over words in lower case with one space between them.

Every rule is (label, pattern). A pattern starts with a literal word, which finds the places to try
it at, covers at most ``MOST_WORDS`` words and always holds one of the ``GATES``, so a text
without any of them needs no rule at all. Only what RE2 and Java read alike is used.
Versions read as they do once punctuation has gone: ``GPL-2.0`` is ``gpl 2 0``.
"""

from __future__ import annotations

MOST_WORDS = 24

#: Parts of words that every match of some rule holds.
GATES = ("licen[cs]e[sd]?", "spdx", "creativecommons", "copyleft", "unlicen[cs]e", "wtfpl", "[al]?gplv?[123]?", "gfdl", "cc0", "cc by", "public domain", "copyright holders?", "redistribution and use",
         "permission is (?:hereby )?granted", "permission to use", "permission notice", "endorse or promote", "acknowledge?ment", "all rights reserved", "as is", "warranty")

_L = "licen[cs]es?"
_GPL = f"general public {_L}"
_FSF = "(?: as published by the free software foundation)?"
_V = "(?: (?:either )?(?:version|v|ver) ?| )"
_LATER = "(?: of the licen[cs]e)?,? or (?:at your option )?(?:any )?later(?: version)?"

#: Sentences of the license texts and of the notices they ask for.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this (?:software|font software)"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("bsd-3-clause", "neither the name of .{1,80} nor the names of (?:its|his|her|their|any) contributors may be used to endorse or promote"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "this software is provided by the (?:copyright holders?|regents|author|authors)(?: and contributors)? as is and any express or implied warranties"),
    ("apache-2.0", f"licensed under the apache {_L} version 2 0"),
    ("apache-2.0", f"licensed to the apache software foundation asf under one or more contributor {_L} agreements"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache-1.1", "this product includes software developed by the apache software foundation http www apache org (?:.{1,40} )?(?:licen[cs]e|redistribution and use)"),
    ("gpl", f"this program is free software you can redistribute it and or modify it under the terms of the gnu {_GPL}"),
    ("lgpl", f"this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) {_GPL}"),
    ("agpl", f"this program is free software you can redistribute it and or modify it under the terms of the gnu affero {_GPL}"),
    ("gpl", f"you should have received a copy of the gnu {_GPL} along with this"),
    ("lgpl", f"you should have received a copy of the gnu (?:lesser|library) {_GPL} along with this"),
    ("agpl", f"you should have received a copy of the gnu affero {_GPL} along with this"),
    ("gfdl", f"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {_L}"),
    ("mpl-2.0", f"this source code form is subject to the terms of the mozilla public {_L} v ?2 0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[cs]e version 2 0"),
    ("mpl-1.1", f"the contents of this file are subject to the mozilla public {_L} version 1 1"),
    ("epl-1.0", f"this program and the accompanying materials are made available under the terms of the eclipse public {_L} v ?1 0"),
    ("epl-2.0", f"this program and the accompanying materials are made available under the terms of the eclipse public {_L} v?(?:ersion)? ?2 0"),
    ("cddl-1.0", f"the contents of this file are subject to the terms of the common development and distribution {_L}"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software (?:.{1,60} )?(?:public domain|warranty|unlicen[cs]e)"),
    ("public-domain", "(?:this|the) (?:software|work|file|code|document) (?:is|has been) (?:hereby )?(?:in|placed in|released into|dedicated to) the public domain"),
    ("public-domain", "placed in the public domain"),
    ("public-domain", "released (?:in)?to the public domain"),
    ("public-domain", "dedicated to the public domain"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", f"this work is licensed under a creative commons attribution (?:[1-4] [05] )?(?:international|unported|generic) {_L}"),
    ("cc-by-sa", f"this work is licensed under a creative commons attribution share ?alike (?:[1-4] [05] )?(?:international|unported|generic) {_L}"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("bsl-1.0", f"distributed under the boost software {_L} version 1 0"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed"),
    ("gnu-text", "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed"),
    ("ofl-1.1", f"this font software is licensed under the sil open font {_L} version 1 1"),
    ("ncsa", "neither the names of .{1,80} nor the names of its contributors may be used to endorse or promote products derived from this software without (?:.{1,40} )?permission"),
    ("x11", "except as contained in this notice the name of .{1,60} shall not be used in advertising (?:.{1,60} )?copyright holders?"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("ms-pl", f"this licen[cs]e governs use of the accompanying software if you use the software you accept this {_L}"),
    ("vim", f"the vim {_L} (?:applies|text)"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff (?:.{1,80} )?beer (?:.{1,40} )?licen[cs]e"),
    ("proprietary", "all rights reserved (?:unauthori[sz]ed|no part of this|reproduction)"),
    ("proprietary", f"proprietary (?:and confidential )?(?:software )?{_L}(?: agreement)?"),
    ("proprietary", f"end user {_L} agreement"),
)

_T = "spdx licen[cs]e identifier "

#: Machine-readable tags.
TAGS = (
    ("mit", _T + "mit"), ("mit-0", _T + "mit 0"), ("isc", _T + "isc"), ("0bsd", _T + "0bsd"), ("bsd-1-clause", _T + "bsd 1 clause"), ("bsd-2-clause", _T + "bsd 2 clause"),
    ("bsd-2-clause-patent", _T + "bsd 2 clause patent"), ("bsd-3-clause", _T + "bsd 3 clause"), ("bsd-3-clause-clear", _T + "bsd 3 clause clear"), ("bsd-4-clause", _T + "bsd 4 clause"),
    ("apache-1.0", _T + "apache 1 0"), ("apache-1.1", _T + "apache 1 1"), ("apache-2.0", _T + "apache 2 0"),
    ("gpl-1.0-only", _T + "gpl 1 0(?: only)?"), ("gpl-1.0-or-later", _T + "gpl 1 0 or later"), ("gpl-2.0-only", _T + "gpl 2 0(?: only)?"), ("gpl-2.0-or-later", _T + "gpl 2 0 or later"),
    ("gpl-2.0-with-classpath-exception", _T + "gpl 2 0(?: only)? with classpath exception 2 0"), ("gpl-3.0-only", _T + "gpl 3 0(?: only)?"), ("gpl-3.0-or-later", _T + "gpl 3 0 or later"),
    ("lgpl-2.0-only", _T + "lgpl 2 0(?: only)?"), ("lgpl-2.0-or-later", _T + "lgpl 2 0 or later"), ("lgpl-2.1-only", _T + "lgpl 2 1(?: only)?"), ("lgpl-2.1-or-later", _T + "lgpl 2 1 or later"),
    ("lgpl-3.0-only", _T + "lgpl 3 0(?: only)?"), ("lgpl-3.0-or-later", _T + "lgpl 3 0 or later"), ("agpl-3.0-only", _T + "agpl 3 0(?: only)?"), ("agpl-3.0-or-later", _T + "agpl 3 0 or later"),
    ("gfdl-1.1", _T + "gfdl 1 1(?: only| or later)?"), ("gfdl-1.2", _T + "gfdl 1 2(?: only| or later)?"), ("gfdl-1.3", _T + "gfdl 1 3(?: only| or later)?"),
    ("mpl-1.0", _T + "mpl 1 0"), ("mpl-1.1", _T + "mpl 1 1"), ("mpl-2.0", _T + "mpl 2 0"), ("mpl-2.0-no-copyleft-exception", _T + "mpl 2 0 no copyleft exception"),
    ("epl-1.0", _T + "epl 1 0"), ("epl-2.0", _T + "epl 2 0"), ("cpl-1.0", _T + "cpl 1 0"), ("cddl-1.0", _T + "cddl 1 0"), ("cddl-1.1", _T + "cddl 1 1"), ("eupl-1.1", _T + "eupl 1 1"), ("eupl-1.2", _T + "eupl 1 2"),
    ("unlicense", _T + "unlicense"), ("wtfpl", _T + "wtfpl"), ("zlib", _T + "zlib"), ("libpng", _T + "libpng(?: 2 0)?"), ("bsl-1.0", _T + "bsl 1 0"), ("busl-1.1", _T + "busl 1 1"), ("artistic-1.0", _T + "artistic 1 0"),
    ("artistic-2.0", _T + "artistic 2 0"), ("afl-3.0", _T + "afl 3 0"), ("osl-3.0", _T + "osl 3 0"), ("ofl-1.1", _T + "ofl 1 1"), ("ncsa", _T + "ncsa"), ("postgresql", _T + "postgresql"), ("psf-2.0", _T + "psf 2 0"),
    ("python-2.0", _T + "python 2 0"), ("ruby", _T + "ruby"), ("php-3.01", _T + "php 3 01"), ("zpl-2.1", _T + "zpl 2 1"), ("ms-pl", _T + "ms pl"), ("ms-rl", _T + "ms rl"), ("upl-1.0", _T + "upl 1 0"), ("vim", _T + "vim"),
    ("w3c", _T + "w3c"), ("x11", _T + "x11"), ("hpnd", _T + "hpnd"), ("cecill-2.1", _T + "cecill 2 1"), ("cecill-b", _T + "cecill b"), ("cecill-c", _T + "cecill c"), ("mulanpsl-2.0", _T + "mulanpsl 2 0"),
    ("elastic-2.0", _T + "elastic 2 0"), ("sspl-1.0", _T + "sspl 1 0"), ("odbl-1.0", _T + "odbl 1 0"), ("odc-by-1.0", _T + "odc by 1 0"), ("pddl-1.0", _T + "pddl 1 0"), ("cdla-permissive-2.0", _T + "cdla permissive 2 0"),
    ("cc0-1.0", _T + "cc0 1 0"), ("cc-by-3.0", _T + "cc by 3 0"), ("cc-by-4.0", _T + "cc by 4 0"), ("cc-by-sa-3.0", _T + "cc by sa 3 0"), ("cc-by-sa-4.0", _T + "cc by sa 4 0"), ("cc-by-nc-4.0", _T + "cc by nc 4 0"),
    ("cc-by-nd-4.0", _T + "cc by nd 4 0"), ("cc-by-nc-sa-4.0", _T + "cc by nc sa 4 0"), ("cc-by-nc-nd-4.0", _T + "cc by nc nd 4 0"), ("proprietary", _T + "licenseref proprietary"), ("licenseref", _T + "licenseref"),
)

_W = "(?:www )?"

#: Addresses of license texts, with or without the scheme in front.
LINKS = (
    ("mit", "opensource org licen[cs]es?(?: php)? mit(?: license)?(?: php| html)?"), ("bsd-2-clause", "opensource org licen[cs]es?(?: php)? bsd 2 clause"),
    ("bsd-3-clause", "opensource org licen[cs]es?(?: php)? bsd 3 clause"), ("bsd-3-clause", "opensource org licen[cs]es?(?: php)? bsd license(?: php)?"), ("isc", "opensource org licen[cs]es?(?: php)? isc(?: license)?"),
    ("apache-2.0", "opensource org licen[cs]es?(?: php)? apache 2 0"), ("mpl-2.0", "opensource org licen[cs]es?(?: php)? mpl 2 0"), ("epl-1.0", "opensource org licen[cs]es?(?: php)? epl 1 0"),
    ("cddl-1.0", "opensource org licen[cs]es?(?: php)? cddl ?1(?: 0)?"), ("artistic-2.0", "opensource org licen[cs]es?(?: php)? artistic license 2 0"), ("ms-pl", "opensource org licen[cs]es?(?: php)? ms pl"),
    ("zlib", "opensource org licen[cs]es?(?: php)? zlib(?: license)?"), ("afl-3.0", "opensource org licen[cs]es?(?: php)? afl 3 0"), ("osl-3.0", "opensource org licen[cs]es?(?: php)? osl 3 0"),
    ("apache-2.0", "apache org licen[cs]es? licen[cs]e 2 0(?: txt| html)?"), ("apache-1.1", "apache org licen[cs]es? licen[cs]e 1 1"), ("apache-1.0", "apache org licen[cs]es? licen[cs]e 1 0"), ("apache", "apache org licen[cs]es?"),
    ("gpl", "gnu org (?:licen[cs]es?|copyleft) gpl(?: html| txt)?"), ("gpl-2.0", "gnu org licen[cs]es? (?:old licenses )?gpl 2 0(?: html| txt)?"), ("gpl-3.0", "gnu org licen[cs]es? gpl 3 0(?: html| txt)?"),
    ("lgpl", "gnu org (?:licen[cs]es?|copyleft) (?:lgpl|lesser)(?: html| txt)?"), ("lgpl-2.1", "gnu org licen[cs]es? (?:old licenses )?lgpl 2 1(?: html| txt)?"), ("lgpl-3.0", "gnu org licen[cs]es? lgpl 3 0(?: html| txt)?"),
    ("agpl-3.0", "gnu org licen[cs]es? agpl 3 0(?: html| txt)?"), ("agpl", "gnu org licen[cs]es? agpl(?: html| txt)?"), ("gfdl", "gnu org (?:licen[cs]es?|copyleft) fdl(?: html| txt)?"), ("gnu-text", "gnu org licen[cs]es?"),
    ("mpl-2.0", "mozilla org mpl 2 0(?: txt)? (?:.{1,20} )?licen[cs]e"), ("mpl-1.1", "mozilla org mpl mpl 1 1(?: html| txt)? (?:.{1,20} )?licen[cs]e"), ("epl-1.0", "eclipse org legal epl v10(?: html)? (?:.{1,20} )?licen[cs]e"),
    ("epl-2.0", "eclipse org legal epl (?:2 0|v20)(?: html)? (?:.{1,20} )?licen[cs]e"), ("bsl-1.0", "boost org licen[cs]e 1 0 txt"), ("unlicense", "unlicense org"), ("wtfpl", "wtfpl net"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0"), ("public-domain", "creativecommons org publicdomain mark 1 0"), ("cc-by", "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons org licenses by sa [1-4] [05]"), ("cc-by-nc", "creativecommons org licenses by nc [1-4] [05]"), ("cc-by-nd", "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa [1-4] [05]"), ("cc-by-nc-nd", "creativecommons org licenses by nc nd [1-4] [05]"), ("cc", "creativecommons org"), ("ofl-1.1", "scripts sil org ofl (?:.{1,20} )?licen[cs]e"),
    ("odbl-1.0", "opendatacommons org licenses odbl(?: 1 0)?"), ("odc-by-1.0", "opendatacommons org licenses by(?: 1 0)?"), ("pddl-1.0", "opendatacommons org licenses pddl(?: 1 0)?"), ("spdx", "spdx org licenses"),
)

#: Names with a version.
VERSIONS = (
    ("apache-2.0", f"apache(?: software)? {_L}{_V}2(?: 0)?"), ("apache-1.1", f"apache(?: software)? {_L}{_V}1 1"), ("apache-1.0", f"apache(?: software)? {_L}{_V}1 0"), ("apache-2.0", f"apache 2(?: 0)? {_L}"),
    ("apache-2.0", f"asl{_V}2 0 {_L}"), ("apache-2.0", f"al2 0 {_L}"),
    ("gpl-1.0", f"gnu {_GPL}{_FSF}{_V}1(?: 0)?"), ("gpl-2.0", f"gnu {_GPL}{_FSF}{_V}2(?: 0)?"), ("gpl-3.0", f"gnu {_GPL}{_FSF}{_V}3(?: 0)?"),
    ("gpl-2.0-or-later", f"gnu {_GPL}{_FSF}{_V}2(?: 0)?{_LATER}"), ("gpl-3.0-or-later", f"gnu {_GPL}{_FSF}{_V}3(?: 0)?{_LATER}"),
    ("gpl-2.0", f"general public {_L}{_FSF}{_V}2(?: 0)?"), ("gpl-3.0", f"general public {_L}{_FSF}{_V}3(?: 0)?"), ("gpl-2.0", "gpl (?:version |v ?)?2(?: 0)?"), ("gpl-3.0", "gpl (?:version |v ?)?3(?: 0)?"),
    ("gpl-2.0", "gplv2"), ("gpl-3.0", "gplv3"), ("gpl-2.0-or-later", "gplv2 or later"), ("gpl-3.0-or-later", "gplv3 or later"), ("gpl-2.0-or-later", "gpl 2 0 or later"), ("gpl-3.0-or-later", "gpl 3 0 or later"),
    ("lgpl-2.0", f"gnu library {_GPL}{_FSF}{_V}2(?: 0)?"), ("lgpl-2.1", f"gnu lesser {_GPL}{_FSF}{_V}2 1"), ("lgpl-3.0", f"gnu lesser {_GPL}{_FSF}{_V}3(?: 0)?"),
    ("lgpl-2.1-or-later", f"gnu lesser {_GPL}{_FSF}{_V}2 1{_LATER}"), ("lgpl-3.0-or-later", f"gnu lesser {_GPL}{_FSF}{_V}3(?: 0)?{_LATER}"), ("lgpl-2.1", "lgpl (?:version |v ?)?2 1"), ("lgpl-3.0", "lgpl (?:version |v ?)?3(?: 0)?"),
    ("lgpl-2.1", "lgplv2 1"), ("lgpl-3.0", "lgplv3"), ("agpl-3.0", f"gnu affero {_GPL}{_FSF}{_V}3(?: 0)?"), ("agpl-3.0-or-later", f"gnu affero {_GPL}{_FSF}{_V}3(?: 0)?{_LATER}"), ("agpl-3.0", "agpl (?:version |v ?)?3(?: 0)?"),
    ("agpl-3.0", "agplv3"), ("gfdl-1.2", f"gnu free documentation {_L}{_V}1 2"), ("gfdl-1.3", f"gnu free documentation {_L}{_V}1 3"),
    ("mpl-1.0", f"mozilla public {_L}{_V}1 0"), ("mpl-1.1", f"mozilla public {_L}{_V}1 1"), ("mpl-2.0", f"mozilla public {_L}{_V}2(?: 0)?"), ("epl-1.0", f"eclipse public {_L}{_V}1 0"), ("epl-2.0", f"eclipse public {_L}{_V}2(?: 0)?"),
    ("edl-1.0", f"eclipse distribution {_L}{_V}1 0"), ("cpl-1.0", f"common public {_L}{_V}1 0"), ("cddl-1.0", f"common development and distribution {_L}{_V}1 0"), ("cddl-1.1", f"common development and distribution {_L}{_V}1 1"),
    ("eupl-1.1", f"european union public {_L}{_V}1 1"), ("eupl-1.2", f"european union public {_L}{_V}1 2"), ("artistic-1.0", f"artistic {_L}{_V}1 0"), ("artistic-2.0", f"artistic {_L}{_V}2 0"),
    ("afl-3.0", f"academic free {_L}{_V}3 0"), ("osl-3.0", f"open software {_L}{_V}3 0"), ("bsl-1.0", f"boost software {_L}{_V}1 0"), ("busl-1.1", f"business source {_L}{_V}1 1"), ("ofl-1.1", f"sil open font {_L}{_V}1 1"),
    ("php-3.01", f"php {_L}{_V}3 01"), ("zpl-2.1", f"zope public {_L}{_V}2 1"), ("python-2.0", f"python(?: software foundation)? {_L}{_V}2"), ("upl-1.0", f"universal permissive {_L}{_V}1 0"), ("elastic-2.0", f"elastic {_L}{_V}2 0"),
    ("sspl-1.0", f"server side public {_L}{_V}1"), ("mulanpsl-2.0", f"mulan permissive software {_L}{_V}2"), ("odbl-1.0", f"open database {_L}{_V}1 0"), ("cecill-2.1", f"cecill(?: free software)? {_L}(?: agreement)?{_V}2 1"),
    ("bsd-2-clause", f"bsd (?:2|two) clause(?: [a-z]+)? {_L}"), ("bsd-3-clause", f"bsd (?:3|three) clause(?: [a-z]+)? {_L}"), ("bsd-4-clause", f"bsd (?:4|four) clause(?: [a-z]+)? {_L}"),
    ("bsd-2-clause", f"simplified bsd {_L}"), ("bsd-3-clause", f"(?:modified|revised) bsd {_L}"), ("bsd-2-clause", f"freebsd {_L}"), ("0bsd", f"zero clause bsd {_L}"), ("bsd-2-clause", f"(?:2|two) clause bsd {_L}"), ("bsd-3-clause", f"(?:3|three) clause bsd {_L}"),
    ("cc0-1.0", "cc0 1 0"), ("cc0-1.0", "creative commons zero(?: v?1 0)?(?: universal)?(?: public domain dedication| licen[cs]e)"),
    ("cc-by-4.0", f"creative commons attribution 4 0(?: international)?(?: public)? {_L}"), ("cc-by-3.0", f"creative commons attribution 3 0(?: unported)? {_L}"), ("cc-by-sa-4.0", f"creative commons attribution share ?alike 4 0(?: international)?(?: public)? {_L}"),
    ("cc-by-sa-3.0", f"creative commons attribution share ?alike 3 0(?: unported)? {_L}"), ("cc-by-nc", f"creative commons attribution non ?commercial (?:[1-4] [05] )?(?:international )?(?:public )?{_L}"),
    ("cc-by-nd", f"creative commons attribution no ?deriv(?:s|atives) (?:[1-4] [05] )?(?:international )?(?:public )?{_L}"), ("cc-by-nc-sa", f"creative commons attribution non ?commercial share ?alike (?:[1-4] [05] )?(?:international )?(?:public )?{_L}"),
    ("cc-by-4.0", "cc by 4 0"), ("cc-by-3.0", "cc by 3 0"), ("cc-by-sa-4.0", "cc by sa 4 0"), ("cc-by-sa-3.0", "cc by sa 3 0"), ("cc-by-nc-4.0", "cc by nc 4 0"), ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"), ("cc-by-nd-4.0", "cc by nd 4 0"),
)

#: Names alone.
NAMES = (
    ("mit", f"mit (?:style |x11 |expat )?{_L}"), ("mit", f"expat {_L}"), ("x11", f"x11 {_L}"), ("isc", f"isc {_L}"), ("bsd", f"bsd (?:style )?{_L}"), ("bsd", f"berkeley software distribution {_L}"), ("apache", f"apache(?: software)? {_L}"),
    ("gpl", f"gnu {_GPL}"), ("gpl", "gnu gpl"), ("gpl", f"gpl {_L}"), ("lgpl", f"(?:lesser|library) {_GPL}"), ("lgpl", f"gnu (?:lesser|library) {_GPL}"), ("lgpl", "gnu lgpl"), ("lgpl", f"lgpl {_L}"), ("agpl", f"gnu affero {_GPL}"),
    ("agpl", f"affero {_GPL}"), ("agpl", "gnu agpl"), ("agpl", f"agpl {_L}"), ("gfdl", f"gnu free documentation {_L}"), ("gfdl", "gfdl"), ("mpl", f"mozilla public {_L}"), ("epl", f"eclipse public {_L}"), ("edl", f"eclipse distribution {_L}"),
    ("cpl", f"common public {_L}"), ("cddl", f"common development and distribution {_L}"), ("eupl", f"european union public {_L}"), ("artistic", f"artistic {_L}"), ("afl", f"academic free {_L}"), ("osl", f"open software {_L}"),
    ("bsl-1.0", f"boost(?: software)? {_L}"), ("busl", f"business source {_L}"), ("ofl", f"(?:sil )?open font {_L}"), ("ofl", f"sil open font {_L}"), ("php", f"php {_L}"), ("zpl", f"zope public {_L}"), ("psf", f"python(?: software foundation)? {_L}"), ("ruby", f"ruby {_L}"),
    ("perl", f"perl (?:artistic )?{_L}"), ("postgresql", f"postgresql {_L}"), ("zlib", f"zlib(?: libpng)? {_L}"), ("libpng", f"libpng {_L}"), ("ncsa", f"university of illinois (?:ncsa )?open source {_L}"), ("ncsa", f"ncsa(?: open source)? {_L}"),
    ("ms-pl", f"microsoft public {_L}"), ("ms-rl", f"microsoft reciprocal {_L}"), ("upl", f"universal permissive {_L}"), ("elastic", f"elastic {_L}"), ("sspl", f"server side public {_L}"), ("mulanpsl", f"mulan permissive software {_L}"),
    ("odbl", f"open database {_L}"), ("odc-by", f"open data commons attribution {_L}"), ("pddl", f"public domain dedication and {_L}"), ("cecill", f"cecill(?: free software)? {_L}"), ("vim", f"vim {_L}"), ("w3c", f"w3c (?:software )?(?:notice and )?{_L}"),
    ("unlicense", "unlicen[cs]e"), ("wtfpl", "wtfpl"), ("beerware", f"beerware {_L}"), ("json", f"json {_L}"), ("curl", f"curl {_L}"), ("openssl", f"openssl {_L}"), ("sleepycat", f"sleepycat {_L}"), ("qpl", f"q public {_L}"), ("ibm-pl", f"ibm public {_L}"),
    ("lppl", f"latex project public {_L}"), ("nasa", f"nasa open source {_L}"), ("open-government", f"open government {_L}"), ("cc", f"creative commons {_L}"), ("cc-by", f"creative commons attribution {_L}"), ("cc-by-sa", f"creative commons attribution share ?alike {_L}"),
    ("cc", f"licensed under (?:a )?creative commons"), ("cc0", "cc0"), ("copyleft", f"copyleft {_L}"), ("public-domain", "public domain (?:dedication|licen[cs]e|mark)"),
)

#: Phrases that always count, whatever else covers them; the registered query reports their places.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: Tier, its rules, priority and confidence. A detection gives way to one of higher priority that contains it.
TIERS = (("notice", NOTICES, 5, 1.0), ("tag", TAGS, 4, 0.95), ("link", LINKS, 3, 0.9), ("version", VERSIONS, 2, 0.8), ("name", NAMES, 1, 0.6), ("base", BASE, 0, 0.5))
