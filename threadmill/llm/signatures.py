"""Signature rules of the license scan, written by hand after the texts, headers and grants of public licenses.

A signature is a pattern over words. Each word is a small regex of its own; ``{ ... }`` is optional,
``( a | b c )`` one of some runs of words, ``*`` any word. ``$NAME`` stands for a run of ``MACROS``.
The British spelling of license is read as the American one. A text can match only if it has all
words that stand outside braces and parentheses and are plain: those are a signature's keywords.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Runs of words that many signatures share.
MACROS = {
    "UNDER": "under { ( the | a | an ) } { terms { and conditions } of } { ( the | a | an ) }",
    "LATER": "{ ( or later | or { ( at your option ) } any later version | or newer | only ) }",
    "V1": "{ ( version | v ) } ( 1 | 1 0 | v1 | v1 0 )",
    "V2": "{ ( version | v ) } ( 2 | 2 0 | v2 | v2 0 )",
    "V3": "{ ( version | v ) } ( 3 | 3 0 | v3 | v3 0 )",
    "ANYV": "{ ( version | v ) } { v?[0-9]+ { [0-9]+ } }",
    "CCV": "{ [1-4] { [05] } } { ( international | unported | generic | universal ) }",
}

#: Tier 0: sentences that only the license itself, or its standard header, has.
#: Tier 1: a grant that names the license. Tier 2: the license's name. Tier 3: hints and statements.
SIGNATURES: list[tuple[int, str, str]] = [
    # --- MIT and its kin
    (0, "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (0, "mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (0, "mit-0", "mit no attribution"),
    (1, "mit", "licensed $UNDER { expat } mit { license }"),
    (1, "mit", "released $UNDER mit { license }"),
    (1, "mit", "distributed $UNDER mit { license }"),
    (1, "mit", "available $UNDER mit { license }"),
    (1, "mit", "published $UNDER mit { license }"),
    (1, "mit", "covered by the mit license"),
    (1, "mit", "subject to the mit license"),
    (1, "mit", "license { is } { the } mit"),
    (2, "mit", "mit { style } license"),
    (2, "mit", "mit { style } licenses"),
    (2, "mit", "expat license"),
    (2, "mit", "mit licensed"),
    (2, "x11", "x11 license"),
    (2, "x11", "mit x11 { license }"),
    (0, "x11", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    (0, "isc", "permission to use copy modify and { or } distribute this software for any purpose with or without fee is hereby granted"),
    (1, "isc", "licensed $UNDER isc { license }"),
    (1, "isc", "released $UNDER isc { license }"),
    (2, "isc", "isc license"),
    (2, "isc", "internet ( systems | software ) consortium license"),
    (0, "0bsd", "zero clause bsd { license }"),
    (2, "0bsd", "0bsd"),
    (2, "0bsd", "bsd zero clause license"),
    (0, "ntp", "permission to use copy modify and distribute this software and its documentation for any purpose { with or } without fee is hereby granted"),
    (0, "hpnd", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    (2, "hpnd", "historical permission notice and disclaimer"),
    (0, "curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    # --- BSD
    (0, "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (0, "bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    (0, "bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    (0, "bsd-3-clause", "neither the name of { * } { * } { * } { * } { * } nor the names of its contributors may be used to endorse or promote products derived from this software"),
    (0, "bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    (1, "bsd", "licensed $UNDER { ( new | modified | simplified | revised | [234] clause ) } bsd { [234] clause } { license }"),
    (1, "bsd", "released $UNDER { ( new | modified | simplified | revised | [234] clause ) } bsd { [234] clause } { license }"),
    (1, "bsd", "distributed $UNDER { ( new | modified | simplified | revised | [234] clause ) } bsd { [234] clause } { license }"),
    (1, "bsd", "governed by a bsd style license"),
    (2, "bsd", "bsd { style } licenses?"),
    (2, "bsd-2-clause", "bsd 2 clause"),
    (2, "bsd-2-clause", "( simplified | freebsd | 2 clause | two clause ) bsd { license }"),
    (2, "bsd-3-clause", "bsd 3 clause"),
    (2, "bsd-3-clause", "( new | modified | revised | 3 clause | three clause ) bsd { license }"),
    (2, "bsd-4-clause", "( original | 4 clause | four clause ) bsd { license }"),
    # --- Apache
    (0, "apache", "licensed under the apache license version 2 0 { the license } you may not use this file except in compliance with the license"),
    (0, "apache", "you may obtain a copy of the license at http www apache org licenses"),
    (0, "apache", "apache license version 2 0 january 2004"),
    (0, "apache-1.1", "this product includes software developed by the apache software foundation"),
    (1, "apache", "licensed $UNDER apache { software } { license } $ANYV"),
    (1, "apache", "released $UNDER apache { software } { license } $ANYV"),
    (1, "apache", "distributed $UNDER apache { software } { license } $ANYV"),
    (1, "apache", "available $UNDER apache { software } { license } $ANYV"),
    (1, "apache", "governed by the apache { license } $ANYV"),
    (1, "apache", "subject to the apache license"),
    (1, "apache", "license { is } { the } apache $ANYV"),
    (2, "apache", "apache { software } license $ANYV"),
    (2, "apache", "apache 2 0"),
    (2, "apache", "asl 2 0"),
    # --- GPL
    (0, "gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    (0, "gpl-2.0", "gnu general public license version 2 june 1991"),
    (0, "gpl-3.0", "gnu general public license version 3 29 june 2007"),
    (0, "gpl", "you should have received a copy of the gnu general public license along with"),
    (1, "gpl", "licensed $UNDER { gnu } general public license $ANYV $LATER"),
    (1, "gpl", "released $UNDER { gnu } general public license $ANYV $LATER"),
    (1, "gpl", "distributed $UNDER { gnu } general public license $ANYV $LATER"),
    (1, "gpl", "available $UNDER { gnu } general public license $ANYV $LATER"),
    (1, "gpl", "licensed $UNDER { gnu } gplv?[123]? { license } $ANYV $LATER"),
    (1, "gpl", "released $UNDER { gnu } gplv?[123]? { license } $ANYV $LATER"),
    (1, "gpl", "distributed $UNDER { gnu } gplv?[123]? { license } $ANYV $LATER"),
    (1, "gpl", "available $UNDER { gnu } gplv?[123]? { license } $ANYV $LATER"),
    (1, "gpl", "governed by the { gnu } gplv?[123]? { license } $ANYV"),
    (2, "gpl", "{ gnu } general public license $ANYV $LATER"),
    (2, "gpl-2.0", "gnu general public license $V2"),
    (2, "gpl-3.0", "gnu general public license $V3"),
    (2, "gpl", "{ gnu } gpl license"),
    (2, "gpl-2.0", "gplv2 { ( or later | only ) }"),
    (2, "gpl-3.0", "gplv3 { ( or later | only ) }"),
    (2, "gpl-2.0", "gpl $V2 $LATER"),
    (2, "gpl-3.0", "gpl $V3 $LATER"),
    (2, "gpl-exception", "classpath exception"),
    (2, "gpl-exception", "gcc runtime library exception"),
    (2, "gpl-exception", "linux syscall note"),
    # --- LGPL, AGPL, GFDL
    (0, "lgpl", "under the terms of the gnu ( lesser | library ) general public license as published by the free software foundation"),
    (0, "lgpl-2.1", "gnu lesser general public license version 2 1 february 1999"),
    (1, "lgpl", "licensed $UNDER { gnu } lesser general public license $ANYV $LATER"),
    (1, "lgpl", "released $UNDER { gnu } lesser general public license $ANYV $LATER"),
    (1, "lgpl", "distributed $UNDER { gnu } lesser general public license $ANYV $LATER"),
    (1, "lgpl", "licensed $UNDER { gnu } lgplv?[23]? { license } $ANYV $LATER"),
    (1, "lgpl", "released $UNDER { gnu } lgplv?[23]? { license } $ANYV $LATER"),
    (2, "lgpl", "{ gnu } lesser general public license { ( version | v ) } { [23] { [01] } } $LATER"),
    (2, "lgpl", "gnu library general public license $ANYV $LATER"),
    (2, "lgpl", "lgpl license"),
    (2, "lgpl", "lgplv2 { 1 } { ( or later | only ) }"),
    (2, "lgpl", "lgplv3 { ( or later | only ) }"),
    (2, "lgpl", "lgpl { ( version | v ) } ( 2 | 2 0 | 2 1 | 3 | 3 0 ) $LATER"),
    (0, "agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    (1, "agpl", "licensed $UNDER { gnu } affero general public license $ANYV $LATER"),
    (1, "agpl", "released $UNDER { gnu } affero general public license $ANYV $LATER"),
    (1, "agpl", "licensed $UNDER { gnu } agplv?3? { license } $ANYV $LATER"),
    (2, "agpl", "{ gnu } affero general public license $ANYV $LATER"),
    (2, "agpl", "agplv3 { ( or later | only ) }"),
    (2, "agpl", "agpl ( license | $V3 )"),
    (0, "gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    (2, "gfdl", "{ gnu } free documentation license { ( version | v ) } { 1 { [123] } }"),
    (2, "gfdl", "gfdl { 1 [123] }"),
    # --- Mozilla, Eclipse, IBM, Sun
    (0, "mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (0, "mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    (1, "mpl", "licensed $UNDER mozilla public { license } $ANYV"),
    (1, "mpl", "released $UNDER mozilla public { license } $ANYV"),
    (1, "mpl", "available $UNDER mozilla public { license } $ANYV"),
    (1, "mpl", "distributed $UNDER mozilla public { license } $ANYV"),
    (1, "mpl", "licensed $UNDER mpl { license } $ANYV"),
    (1, "mpl", "released $UNDER mpl { license } $ANYV"),
    (2, "mpl", "mozilla public license $ANYV"),
    (2, "mpl", "mpl license"),
    (2, "mpl", "mpl ( 1 | 2 ) [01]"),
    (0, "epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    (2, "epl", "eclipse public license $ANYV"),
    (2, "epl", "epl ( v10 | v20 | v { [12] } 0 | [12] 0 )"),
    (2, "edl", "eclipse distribution license $ANYV"),
    (0, "cpl", "this program and the accompanying materials are made available under the terms of the common public license"),
    (2, "cpl", "common public license $ANYV"),
    (2, "ipl", "ibm public license $ANYV"),
    (0, "cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    (2, "cddl", "common development and distribution license $ANYV"),
    (2, "cddl", "cddl { ( version | v ) } 1 [01]"),
    (2, "cddl", "cddl license"),
    (2, "sissl", "sun industry standards source license"),
    (2, "spl", "sun public license"),
    (2, "bcl", "( oracle | sun ) binary code license { agreement }"),
    (2, "otn", "oracle technology network license { agreement }"),
    (2, "upl", "universal permissive license $ANYV"),
    (0, "upl", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software"),
    # --- other free software licenses
    (0, "zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
    (0, "zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    (1, "zlib", "licensed $UNDER zlib { libpng } { license }"),
    (2, "zlib", "zlib { libpng } license"),
    (2, "libpng", "libpng license"),
    (0, "boost", "distributed under the boost software license version 1 0"),
    (0, "boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    (2, "boost", "boost software license $ANYV"),
    (2, "boost", "bsl 1 0"),
    (0, "artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    (1, "artistic", "under the same terms as perl itself"),
    (2, "artistic", "artistic license $ANYV"),
    (0, "unlicense", "this is free and unencumbered software released into the public domain"),
    (2, "unlicense", "the unlicense"),
    (2, "unlicense", "unlicense org"),
    (0, "wtfpl", "do what the fuck you want to public license"),
    (2, "wtfpl", "wtfpl"),
    (2, "beerware", "the beer ware license"),
    (2, "beerware", "beerware license"),
    (0, "beerware", "you can do whatever you want with this stuff if we meet some day"),
    (0, "psf", "psf license agreement for python"),
    (2, "psf", "python software foundation license $ANYV"),
    (2, "cnri", "cnri python license"),
    (0, "php", "this source file is subject to version 3 01 of the php license"),
    (2, "php", "php license { version } { 3 { 01? } }"),
    (2, "ruby", "ruby license"),
    (1, "ruby", "under the same terms as ruby"),
    (0, "openssl", "this product includes software developed by the openssl project"),
    (2, "openssl", "openssl { ssleay } license"),
    (2, "openssl", "ssleay license"),
    (2, "postgresql", "postgresql license"),
    (2, "vim", "vim license"),
    (2, "tcl", "tcl tk license"),
    (2, "ncsa", "{ university of illinois } ncsa { open source } license"),
    (2, "ecl", "educational community license $ANYV"),
    (2, "afl", "academic free license $ANYV"),
    (2, "osl", "open software license $ANYV"),
    (2, "rpl", "reciprocal public license $ANYV"),
    (2, "qpl", "q public license $ANYV"),
    (2, "w3c", "w3c software { notice } { and } { document } { license }"),
    (2, "zpl", "zope public license $ANYV"),
    (2, "cecill", "cecill { [bc] } { license } { ( version | v ) } { [12] { [01] } }"),
    (0, "cecill", "this software is governed by the cecill { [bc] } license"),
    (2, "eupl", "european union public license $ANYV"),
    (0, "eupl", "licensed under the eupl"),
    (2, "eupl", "eupl { ( version | v ) } 1 [012]"),
    (2, "ms-pl", "microsoft public license { ms pl }"),
    (2, "ms-rl", "microsoft reciprocal license { ms rl }"),
    (2, "ms-pl", "ms pl"),
    (2, "ms-rl", "ms rl"),
    (2, "mulan-psl", "mulan permissive software license { v?2? }"),
    (2, "mulan-psl", "mulan psl v2"),
    (2, "nasa", "nasa open source agreement { 1 3 }"),
    (2, "icu", "icu license"),
    (0, "unicode", "unicode inc license agreement data files and software"),
    (2, "unicode", "unicode license agreement"),
    (2, "json", "json license"),
    (0, "json", "the software shall be used for good not evil"),
    (2, "imagemagick", "imagemagick license"),
    (0, "ijg", "this software is based in part on the work of the independent jpeg group"),
    (0, "freetype", "portions of this software are copyright { * } { * } the freetype project"),
    (2, "freetype", "freetype project license"),
    (2, "intel", "intel simplified software license"),
    (2, "blueoak", "blue oak model license { 1 0 0 }"),
    (2, "parity", "parity public license { 7 0 0 }"),
    (2, "opensolaris", "opensolaris license"),
    (2, "sleepycat", "sleepycat license"),
    (2, "netscape", "netscape public license $ANYV"),
    (2, "apsl", "apple public source license $ANYV"),
    (2, "rpsl", "realnetworks public source license $ANYV"),
    (2, "lppl", "latex project public license { ( version | v ) } { 1 3[abc]? }"),
    (0, "lppl", "this work may be distributed and or modified under the conditions of the latex project public license"),
    (2, "gust", "gust font license"),
    # --- fonts, documents, data
    (0, "ofl", "this font software is licensed under the sil open font license version 1 1"),
    (2, "ofl", "sil open font license $ANYV"),
    (2, "ofl", "open font license"),
    (2, "ofl", "ofl 1 1"),
    (2, "ufl", "ubuntu font license { 1 0 }"),
    (2, "bitstream-vera", "bitstream vera fonts copyright"),
    (0, "odbl", "made available under the open database license"),
    (2, "odbl", "open { data commons open } database license $ANYV"),
    (2, "odbl", "odbl { 1 0 }"),
    (2, "odc-by", "open data commons attribution license"),
    (2, "odc-by", "odc by { 1 0 }"),
    (2, "pddl", "public domain dedication and license"),
    (2, "pddl", "pddl { 1 0 }"),
    (2, "cdla", "community data license agreement { ( permissive | sharing ) } { [12] 0 }"),
    (2, "cdla", "cdla ( permissive | sharing ) { [12] 0 }"),
    (0, "ogl-uk", "contains public sector information licensed under the open government license"),
    (2, "ogl-uk", "open government license { v?[123] { 0 } }"),
    (2, "etalab", "( licence | license ) ouverte { etalab }"),
    (2, "dl-de", "datenlizenz deutschland { namensnennung } { zero } { version } { 2 0 }"),
    (2, "nlod", "norwegian license for open government data"),
    (2, "o-uda", "open use of data agreement { v1 0 }"),
    (2, "c-uda", "computational use of data agreement { v1 0 }"),
    # --- Creative Commons
    (1, "cc-by-nc-nd", "licensed $UNDER { creative commons } { cc } ( by nc nd | attribution noncommercial noderiv(?:ative)?s | attribution non commercial no deriv(?:ative)?s ) $CCV { license }"),
    (1, "cc-by-nc-sa", "licensed $UNDER { creative commons } { cc } ( by nc sa | attribution noncommercial sharealike | attribution non commercial share alike ) $CCV { license }"),
    (1, "cc-by-nc", "licensed $UNDER { creative commons } { cc } ( by nc | attribution noncommercial | attribution non commercial ) $CCV { license }"),
    (1, "cc-by-nd", "licensed $UNDER { creative commons } { cc } ( by nd | attribution noderiv(?:ative)?s | attribution no derivatives ) $CCV { license }"),
    (1, "cc-by-sa", "licensed $UNDER { creative commons } { cc } ( by sa | attribution sharealike | attribution share alike ) $CCV { license }"),
    (1, "cc-by", "licensed $UNDER ( creative commons attribution | cc by ) $CCV { license }"),
    (2, "cc-by-nc-nd", "creative commons attribution ( noncommercial | non commercial ) ( noderivs | noderivatives | no derivatives | no derivs ) $CCV { license }"),
    (2, "cc-by-nc-sa", "creative commons attribution ( noncommercial | non commercial ) ( sharealike | share alike ) $CCV { license }"),
    (2, "cc-by-nc", "creative commons attribution ( noncommercial | non commercial ) $CCV { license }"),
    (2, "cc-by-nd", "creative commons attribution ( noderivs | noderivatives | no derivatives | no derivs ) $CCV { license }"),
    (2, "cc-by-sa", "creative commons attribution ( sharealike | share alike ) $CCV { license }"),
    (2, "cc-by", "creative commons attribution $CCV { license }"),
    (2, "cc-by-nc-nd", "cc by nc nd $CCV"),
    (2, "cc-by-nc-sa", "cc by nc sa $CCV"),
    (2, "cc-by-nc", "cc by nc $CCV"),
    (2, "cc-by-nd", "cc by nd $CCV"),
    (2, "cc-by-sa", "cc by sa $CCV"),
    (2, "cc-by", "cc by $CCV"),
    (2, "cc0", "creative commons zero { v?1 { 0 } } { universal }"),
    (2, "cc0", "cc0 { 1 0 } { universal }"),
    (0, "cc0", "to the extent possible under law { * } { * } { * } { * } { * } has waived all copyright and related or neighboring rights"),
    (0, "cc-by-nc-nd", "creativecommons org licenses by nc nd"),
    (0, "cc-by-nc-sa", "creativecommons org licenses by nc sa"),
    (0, "cc-by-nc", "creativecommons org licenses by nc"),
    (0, "cc-by-nd", "creativecommons org licenses by nd"),
    (0, "cc-by-sa", "creativecommons org licenses by sa"),
    (0, "cc-by", "creativecommons org licenses by"),
    (0, "cc0", "creativecommons org publicdomain zero"),
    (3, "creative-commons", "creative commons license"),
    # --- source available, models
    (2, "sspl", "server side public license { ( version | v ) } { v?1 }"),
    (2, "sspl", "sspl { v?1 }"),
    (2, "busl", "business source license $ANYV"),
    (2, "busl", "busl { 1 1 }"),
    (2, "elastic", "elastic license { ( version | v ) } { v?2 { 0 } }"),
    (2, "commons-clause", "commons clause license condition"),
    (0, "commons-clause", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    (2, "polyform", "polyform ( noncommercial | small business | shield | strict | perimeter ) license { 1 0 0 }"),
    (2, "confluent", "confluent community license"),
    (2, "redis", "redis source available license"),
    (2, "timescale", "timescale license"),
    (2, "openrail", "openrail { m }"),
    (1, "openrail", "licensed under the responsible ai license"),
    (2, "openrail", "responsible ai { model } license"),
    (2, "openrail", "bigscience rail license"),
    (2, "llama", "llama { [234] { [0-9] } } community license { agreement }"),
    (2, "gemma", "gemma terms of use"),
    (2, "falcon", "falcon llm license"),
    (2, "apache", "apache license 2 0 with llvm exceptions?"),
    # --- public domain, proprietary, rights
    (3, "public-domain", "dedicated to the public domain"),
    (3, "public-domain", "released into the public domain"),
    (3, "public-domain", "placed in the public domain"),
    (3, "public-domain", "in the public domain"),
    (3, "public-domain", "public domain mark { 1 0 }"),
    (3, "public-domain", "work of the united states government"),
    (3, "proprietary", "proprietary and confidential"),
    (3, "proprietary", "confidential and proprietary"),
    (3, "proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
    (3, "proprietary", "end user license agreement"),
    (3, "proprietary", "for internal use only"),
    (3, "proprietary", "no part of this publication may be reproduced"),
    (3, "proprietary", "licensed not sold"),
    (3, "proprietary", "nutzung ohne genehmigung nicht gestattet"),
    (3, "proprietary", "reproduction interdite"),
    (3, "copyright", "all rights reserved"),
    (3, "copyright", "alle rechte vorbehalten"),
    (3, "copyright", "tous droits réservés"),
    (3, "copyright", "todos los derechos reservados"),
    (3, "copyright", "copyright { c } { © } (?:19|20)[0-9]{2}"),
    (3, "copyright", "© (?:19|20)[0-9]{2}"),
]

#: SPDX identifiers and the labels that the others have; each gives one more signature of tier 0.
SPDX = {
    "MIT": "mit", "MIT-0": "mit-0", "ISC": "isc", "0BSD": "0bsd", "X11": "x11", "BSD-2-Clause": "bsd-2-clause", "BSD-3-Clause": "bsd-3-clause", "BSD-4-Clause": "bsd-4-clause",
    "Apache-1.1": "apache-1.1", "Apache-2.0": "apache", "GPL-1.0": "gpl", "GPL-2.0": "gpl-2.0", "GPL-3.0": "gpl-3.0", "LGPL-2.0": "lgpl", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-1.0": "agpl", "AGPL-3.0": "agpl",
    "GFDL-1.2": "gfdl", "GFDL-1.3": "gfdl", "MPL-1.1": "mpl", "MPL-2.0": "mpl", "EPL-1.0": "epl", "EPL-2.0": "epl", "CPL-1.0": "cpl", "CDDL-1.0": "cddl", "CDDL-1.1": "cddl", "UPL-1.0": "upl", "Zlib": "zlib", "Libpng": "libpng",
    "BSL-1.0": "boost", "Artistic-1.0": "artistic", "Artistic-2.0": "artistic", "Unlicense": "unlicense", "WTFPL": "wtfpl", "Beerware": "beerware", "PSF-2.0": "psf", "Python-2.0": "psf", "PHP-3.01": "php", "Ruby": "ruby",
    "OpenSSL": "openssl", "PostgreSQL": "postgresql", "Vim": "vim", "NCSA": "ncsa", "ECL-2.0": "ecl", "AFL-3.0": "afl", "OSL-3.0": "osl", "W3C": "w3c", "ZPL-2.1": "zpl", "CECILL-2.1": "cecill", "EUPL-1.2": "eupl",
    "MS-PL": "ms-pl", "MS-RL": "ms-rl", "MulanPSL-2.0": "mulan-psl", "Unicode-3.0": "unicode", "JSON": "json", "OFL-1.1": "ofl", "LPPL-1.3c": "lppl", "ODbL-1.0": "odbl", "ODC-By-1.0": "odc-by", "PDDL-1.0": "pddl",
    "CDLA-Permissive-2.0": "cdla", "CC0-1.0": "cc0", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc", "CC-BY-ND-4.0": "cc-by-nd", "CC-BY-NC-SA-4.0": "cc-by-nc-sa", "CC-BY-NC-ND-4.0": "cc-by-nc-nd",
    "SSPL-1.0": "sspl", "BUSL-1.1": "busl", "Elastic-2.0": "elastic",
}

#: Words that nearly every text has: they are no keywords.
_COMMON = set("the of and to is in a an or by for this that any with as at on not you are be it all".split())
_PLAIN = re.compile(r"(?:[^\W_]|©)+")
_STRUCTURE = {"{": "(?:", "}": ")?", "(": "(?:", "|": "|", ")": ")", "*": "<[^<>]+>"}


class Rule(NamedTuple):
    """``order`` is the priority within all rules; ``needs`` are the keywords, the longest one first."""

    order: int
    tier: int
    label: str
    needs: tuple[str, ...]
    regex: str


def _words(pattern: str) -> list[str]:
    out: list[str] = []
    for word in pattern.split():
        out += _words(MACROS[word[1:]]) if word[0] == "$" else [word]
    return out


def compile_pattern(pattern: str) -> tuple[str, tuple[str, ...]]:
    """The regex over ``<word><word>`` and the keywords that every match contains."""
    regex, needs, depth = [], set(), 0
    for word in _words(pattern):
        if word in _STRUCTURE:
            depth += (word in "{(") - (word in "})")
            regex.append(_STRUCTURE[word])
            continue
        regex.append(f"<(?:{word})>" if "|" in word else f"<{word}>")
        if not depth and _PLAIN.fullmatch(word) and word not in _COMMON:
            needs.add(word)
    if depth or not needs:
        raise ValueError(f"braces don't match, or no plain word: {pattern}")
    return "".join(regex), tuple(sorted(needs, key=lambda w: (-len(w), w)))


def rules() -> list[Rule]:
    """All rules in order of priority: by tier, then as they stand."""
    spdx = [(0, label, "spdx license identifier " + " ".join(re.findall("[a-z0-9]+", name.lower())) + " { ( only | or later ) }") for name, label in SPDX.items()]
    found = sorted([*SIGNATURES, *spdx], key=lambda s: s[0])
    return [Rule(i, tier, label, *reversed(compile_pattern(pattern))) for i, (tier, label, pattern) in enumerate(found)]
