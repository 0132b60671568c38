"""License detection by ordered signature rules, as DataFrame expressions only.

A text is reduced to its words: ``A-Z`` lower-cased, everything but ASCII letters, digits and
non-ASCII characters replaced by one space.  Rules are regular expressions over that form; each
has a keyword, and only rules whose keyword occurs in a text are tried on it.  Texts without any
word that could begin a rule or a base phrase are only counted.

Detections are sorted by start, longest first, then priority (a lower number is stronger).  A
detection inside an earlier one of this order is suppressed.  What is left has rising starts and
ends; of two neighbours that overlap in part, the weaker one goes, and the later if they are
equal.

The table of rules travels in the plan as one array, and a text is read once for each rule whose
keyword is found.  Running sums and maxima over n detections are taken by blocks of about sqrt(n),
as an accumulating array would be copied at each step.  There is no shuffle.

Defined cases: a null text counts as empty; a text without words gives zero counts, null first
and last word, empty labels and score 0.  Repeated rows give repeated rows; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.functions.spans import quoted, with_computed

#: Phrases of the base rule and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License families: label, keyword, the ways the name is written (over words), the SPDX identifier's words.
NAMES = [
    ("apache-1.0", "apache", r"apache (?:software )?licen[sc]e (?:version |v )?1 0", "apache 1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e (?:version |v )?1 1", "apache 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e (?:version |v )?v?2(?: 0)?", "apache 2 0"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", "apache"),
    ("mit", "licen", r"(?:mit|expat|x11) (?:style )?licen[sc]e", "mit"),
    ("mit-0", "mit", r"mit no attribution(?: licen[sc]e)?", "mit 0"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd (?:style )?licen[sc]e|bsd 2 clause(?: licen[sc]e)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd (?:style )?licen[sc]e|bsd 3 clause(?: licen[sc]e)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd (?:style )?licen[sc]e|bsd 4 clause(?: licen[sc]e)?", "bsd 4 clause"),
    ("bsd", "bsd", r"bsd (?:style )?licen[sc]e", "bsd"),
    ("0bsd", "bsd", r"(?:zero clause|0 clause) bsd(?: licen[sc]e)?", "0bsd"),
    ("isc", "isc", r"isc licen[sc]e", "isc"),
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl (?:version |v )?v?1(?: 0)?(?: or later)?|gplv1", r"gpl 1 0(?: only| or later)?"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v )?v?1(?: 0)?(?: or later)?", None),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl (?:version |v )?v?2(?: 0)?(?: or later)?|gplv2", r"gpl 2 0(?: only| or later)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v )?v?2(?: 0)?(?: or later)?", None),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl (?:version |v )?v?3(?: 0)?(?: or later)?|gplv3", r"gpl 3 0(?: only| or later)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v )?v?3(?: 0)?(?: or later)?", None),
    ("gpl", "gnu g", r"gnu (?:gpl|general public licen[sc]e)", None),
    ("gpl", "gpl", r"gnu gpl", "gpl"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl (?:version |v )?v?2(?: 0)?(?: or later)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public licen[sc]e (?:version |v )?v?2(?: 0)?(?: or later)?", None),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl (?:version |v )?v?2 1(?: or later)?", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v )?v?2 1(?: or later)?", None),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl (?:version |v )?v?3(?: 0)?(?: or later)?|lgplv3", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v )?v?3(?: 0)?(?: or later)?", None),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", "lgpl"),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", None),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl (?:version |v )?v?3(?: 0)?(?: or later)?|agplv3", r"agpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e (?:version |v )?v?3(?: 0)?(?: or later)?", None),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", None),
    ("agpl", "agpl", r"(?:gnu )?agpl", "agpl"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[sc]e", r"gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e (?:version |v )?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e (?:version |v )?2(?: 0)?", "mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", "mpl"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e (?:version |v )?1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e (?:version |v )?2(?: 0)?", "epl 2 0"),
    ("epl", "eclipse", r"eclipse public licen[sc]e", "epl"),
    ("cddl", "common", r"common development and distribution licen[sc]e", r"cddl 1 [01]"),
    ("cpl", "common", r"common public licen[sc]e", "cpl 1 0"),
    ("eupl", "european", r"european union public licen[sc]e", r"eupl 1 [012]"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e (?:version |v )?1(?: 0)?", "artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e (?:version |v )?2(?: 0)?", "artistic 2 0"),
    ("artistic", "artistic", r"artistic licen[sc]e", "artistic"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e", "zlib"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e", "bsl 1 0"),
    ("unlicense", "unlicense", r"the unlicense", "unlicense"),
    ("wtfpl", "public", r"do what the fuck you want to public licen[sc]e", "wtfpl"),
    ("psf-2.0", "licen", r"(?:python software foundation|psf) licen[sc]e", "psf 2 0"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[sc]e", r"ofl 1 [01]"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", "ms rl"),
    ("openssl", "openssl", r"openssl licen[sc]e", "openssl"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("php", "php", r"php licen[sc]e", r"php 3 0[01]?"),
    ("ruby", "ruby", r"ruby licen[sc]e", "ruby"),
    ("vim", "vim", r"vim licen[sc]e", "vim"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source licen[sc]e", "ncsa"),
    ("upl-1.0", "universal", r"universal permissive licen[sc]e", "upl 1 0"),
    ("osl-3.0", "open", r"open software licen[sc]e", "osl 3 0"),
    ("afl-3.0", "academic", r"academic free licen[sc]e", "afl 3 0"),
    ("odbl", "database", r"open (?:data commons open )?database licen[sc]e", "odbl 1 0"),
    ("odc-by", "attribution", r"open data commons attribution licen[sc]e", "odc by 1 0"),
    ("sspl-1.0", "server", r"server side public licen[sc]e", "sspl 1 0"),
    ("busl-1.1", "business", r"business source licen[sc]e", "busl 1 1"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e", "elastic 2 0"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by", "attribution", r"creative commons attribution(?: [1234] \d)?(?: international| unported)?(?: licen[sc]e)?", r"cc by [1234] \d"),
    ("cc-by-sa", "attribution", r"(?:creative commons )?attribution share ?alike(?: [1234] \d)?(?: international| unported)?(?: licen[sc]e)?", r"cc by sa [1234] \d"),
    ("cc-by-nc", "attribution", r"(?:creative commons )?attribution non ?commercial(?: [1234] \d)?(?: international| unported)?(?: licen[sc]e)?", r"cc by nc [1234] \d"),
    ("cc-by-nd", "attribution", r"(?:creative commons )?attribution no ?deriv(?:ative)?s(?: [1234] \d)?(?: international| unported)?(?: licen[sc]e)?", r"cc by nd [1234] \d"),
    ("cc-by-nc-sa", "attribution", r"(?:creative commons )?attribution non ?commercial share ?alike(?: [1234] \d)?(?: licen[sc]e)?", r"cc by nc sa [1234] \d"),
    ("cc-by-nc-nd", "attribution", r"(?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] \d)?(?: licen[sc]e)?", r"cc by nc nd [1234] \d"),
]
#: Signatures of clauses, notices and addresses: label, priority, strength, keyword, pattern.
CLAUSES = [
    ("mit", 20, 0.95, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 21, 0.9, "without restriction", r"to deal in the software without restriction"),
    ("isc", 20, 0.95, "permission to use", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee"),
    ("bsd", 20, 0.95, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 19, 0.95, "neither the name", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse"),
    ("bsd-4-clause", 19, 0.95, "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", 20, 0.95, "you may not use this file", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-2.0", 18, 0.95, "apache", r"apache org licen[sc]es licen[sc]e 2 0"),
    ("gpl", 20, 0.95, "free software", r"this (?:program|library|file|work) is free software you can redistribute it and or modify it under the terms"),
    ("gpl", 18, 0.9, "gnu", r"gnu org licen[sc]es(?: gpl)?"),
    ("zlib", 20, 0.95, "altered source", r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", 20, 0.9, "boost", r"boost org license 1 0"),
    ("mpl-2.0", 20, 0.95, "mozilla", r"mozilla org mpl 2 0"),
    ("unlicense", 20, 0.95, "public domain", r"free and unencumbered software released into the public domain"),
    ("public-domain", 40, 0.6, "public domain", r"(?:is |been )?(?:dedicated|released|placed|put) (?:in|into|to) the public domain"),
    ("public-domain", 50, 0.4, "public domain", r"public domain"),
    ("cc0", 18, 0.95, "publicdomain", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", 18, 0.95, "creativecommons", r"creativecommons org licen[sc]es by [1234] \d"),
    ("cc-by-sa", 17, 0.95, "creativecommons", r"creativecommons org licen[sc]es by sa [1234] \d"),
    ("cc-by-nc", 17, 0.95, "creativecommons", r"creativecommons org licen[sc]es by nc [1234] \d"),
    ("cc-by-nd", 17, 0.95, "creativecommons", r"creativecommons org licen[sc]es by nd [1234] \d"),
    ("cc-by-nc-sa", 16, 0.95, "creativecommons", r"creativecommons org licen[sc]es by nc sa [1234] \d"),
    ("cc-by-nc-nd", 16, 0.95, "creativecommons", r"creativecommons org licen[sc]es by nc nd [1234] \d"),
    ("cc-by", 40, 0.7, "cc by", r"cc by(?: [1234] \d)?"),
    ("cc-by-sa", 39, 0.8, "cc by", r"cc by sa(?: [1234] \d)?"),
    ("cc-by-nc", 39, 0.8, "cc by", r"cc by nc(?: [1234] \d)?"),
    ("cc-by-nd", 39, 0.8, "cc by", r"cc by nd(?: [1234] \d)?"),
    ("cc-by-nc-sa", 38, 0.8, "cc by", r"cc by nc sa(?: [1234] \d)?"),
    ("cc-by-nc-nd", 38, 0.8, "cc by", r"cc by nc nd(?: [1234] \d)?"),
    ("reserved", 60, 0.5, "all rights reserved", r"all rights reserved"),
    ("copyright", 70, 0.3, "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*"),
    ("copyright", 80, 0.2, "copyright", r"(?:copyright (?:notice|holders?|owners?)|copyrighted)"),
    ("proprietary", 45, 0.7, "confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", 46, 0.6, "proprietary", r"proprietary (?:software )?licen[sc]e"),
    ("no-warranty", 75, 0.3, "warrant", r"(?:without (?:any )?warranty|as is without (?:any )?warranty|without warranties or conditions)"),
]
#: Sentences of the licenses' own texts, notices that go with them, exceptions and reservations: fixed
#: values in the same form.  A rule's keyword is a stretch of its own pattern.
SENTENCES = [
    ("gpl-2.0", 17, 0.95, "either version 2", r"either version 2 of the licen[sc]e or (?:at your option )?any later version"),
    ("gpl-3.0", 17, 0.95, "either version 3", r"either version 3 of the licen[sc]e or (?:at your option )?any later version"),
    ("gpl-2.0", 17, 0.9, "version 2 as published", r"version 2 as published by the free software foundation"),
    ("gpl-3.0", 17, 0.9, "version 3 as published", r"version 3 as published by the free software foundation"),
    ("gpl", 21, 0.9, "have received a copy of the gnu general", r"you should have received a copy of the gnu general public licen[sc]e along with"),
    ("lgpl", 19, 0.9, "copy of the gnu lesser", r"you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("lgpl", 19, 0.9, "copy of the gnu library", r"you should have received a copy of the gnu library general public licen[sc]e"),
    ("agpl", 19, 0.9, "copy of the gnu affero", r"you should have received a copy of the gnu affero general public licen[sc]e"),
    ("gpl", 45, 0.6, "write to the free software", r"write to the free software foundation(?: inc)?"),
    ("gpl", 40, 0.6, "even the implied warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", 22, 0.9, "proprietary programs", r"does not permit incorporating your program into proprietary programs"),
    ("gpl-3.0", 18, 0.9, "in any other way", r"this licen[sc]e gives no permission to licen[sc]e the work in any other way"),
    ("gpl-3.0", 18, 0.9, "to convey a work", r"to convey a work means any kind of propagation that enables other parties"),
    ("gpl", 24, 0.8, "preferred form of the work", r"(?:the )?preferred form of the work for making modifications to it"),
    ("agpl-3.0", 18, 0.9, "interacting with it remotely", r"all users interacting with it remotely through a computer network"),
    ("lgpl", 22, 0.9, "designed to work with the library", r"contains no derivative of any portion of the library but is designed to work with the library"),
    ("gpl", 50, 0.5, "verbatim copies of this license", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("wtfpl", 20, 0.9, "verbatim or modified", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("gfdl", 18, 0.95, "modify this document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("linking-exception", 15, 0.9, "permission to link", r"as a special exception the copyright holders? of (?:this|the) (?:library|program|software) gives? (?:you )?permission to link"),
    ("classpath-exception", 15, 0.9, "classpath", r"(?:gnu )?classpath (?:linking )?exception"),
    ("gcc-exception", 15, 0.9, "runtime library exception", r"gcc runtime library exception"),
    ("autoconf-exception", 15, 0.9, "autoconf", r"as part of a program that contains a configuration script generated by autoconf"),
    ("bison-exception", 15, 0.9, "bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("font-exception", 15, 0.9, "document which uses this font", r"if you create a document which uses this font and embed this font"),
    ("openssl-exception", 15, 0.9, "openssl library", r"permission to link the code of (?:portions of )?(?:this|the) program with the openssl library"),
    ("llvm-exception", 15, 0.9, "llvm", r"(?:with )?llvm exceptions?"),
    ("linux-syscall-note", 15, 0.9, "kernel services", r"this copyright does not cover user programs that use kernel services"),
    ("mit", 22, 0.9, "this permission notice shall be included", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", 30, 0.7, "express or implied including but not limited to the warranties", r"without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", 31, 0.7, "authors or copyright holders be liable", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("x11", 19, 0.9, "except as contained in this notice", r"except as contained in this notice the names? of (?:\S+ ){1,12}shall not be used in advertising"),
    ("bsd", 22, 0.9, "redistributions of source code", r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", 23, 0.9, "redistributions in binary form", r"redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd", 24, 0.85, "any express or implied warranties", r"(?:is|are) provided by the (?:regents|copyright holders?|authors?) (?:and contributors )?as is and any express or implied warranties"),
    ("bsd-3-clause", 20, 0.85, "endorse or promote products", r"may (?:not )?be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", 21, 0.85, "author disclaims all warranties", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("hpnd", 19, 0.9, "and its documentation for any purpose", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose"),
    ("apache-2.0", 19, 0.95, "contributor license agreements", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2.0", 21, 0.9, "agreed to in writing", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e"),
    ("apache-2.0", 21, 0.9, "specific language governing", r"the specific language governing permissions and limitations under the licen[sc]e"),
    ("apache-2.0", 21, 0.9, "each contributor hereby grants", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("apache-1.1", 21, 0.85, "developed by the apache", r"this product includes software developed by the apache software foundation"),
    ("mpl-2.0", 19, 0.95, "source code form is subject", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("mpl-2.0", 20, 0.9, "mpl was not distributed", r"if a copy of the mpl was not distributed with this file"),
    ("mpl-1.1", 20, 0.9, "contents of this file are subject to the mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e"),
    ("epl", 20, 0.9, "accompanying materials are made available", r"this program and the accompanying materials are made available under the terms of the eclipse"),
    ("cddl", 20, 0.9, "cddl header", r"when distributing covered (?:code|software) include this cddl header"),
    ("zlib", 21, 0.9, "must not be misrepresented", r"the origin of this software must not be misrepresented"),
    ("zlib", 22, 0.85, "authors be held liable", r"in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", 19, 0.95, "person or organization obtaining a copy", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicense", 21, 0.9, "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", 19, 0.9, "to the extent possible under law", r"to the extent possible under law (?:\S+ ){1,12}has waived all copyright and related or neighboring rights"),
    ("cc", 42, 0.7, "creative commons", r"this (?:work|article|material|text|image) is licensed under a creative commons"),
    ("cc-by", 42, 0.6, "give appropriate credit", r"you must give appropriate credit provide a link to the licen[sc]e and indicate if changes were made"),
    ("cc-by-sa", 41, 0.6, "under the same license as the original", r"you must distribute your contributions under the same license as the original"),
    ("ofl-1.1", 19, 0.95, "this font software is licensed", r"this font software is licensed under the sil open font licen[sc]e"),
    ("ofl-1.1", 25, 0.8, "reserved font name", r"with reserved font names?"),
    ("artistic", 20, 0.9, "source form of the standard version", r"you may make and give away verbatim copies of the source form of the standard version"),
    ("psf-2.0", 20, 0.9, "psf is making python available", r"psf is making python (?:\S+ ){0,4}available to licensee on an as is basis"),
    ("php", 20, 0.9, "includes php software", r"this product includes php software freely available from"),
    ("openssl", 20, 0.9, "openssl toolkit", r"software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", 21, 0.85, "cryptographic software written by", r"this product includes cryptographic software written by eric young"),
    ("beerware", 20, 0.9, "whatever you want with this stuff", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("json", 20, 0.9, "for good not evil", r"the software shall be used for good not evil"),
    ("unicode", 20, 0.9, "unicode data files", r"any person obtaining a copy of the unicode data files"),
    ("libpng", 20, 0.9, "png reference library", r"the png reference library is supplied as is"),
    ("freetype", 20, 0.9, "freetype project", r"portions of this software are copyright (?:\S+ ){0,6}the freetype project"),
    ("ijg", 20, 0.9, "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("ms-pl", 21, 0.85, "bring a patent claim", r"if you bring a patent claim against any contributor over patents that you claim are infringed"),
    ("sspl-1.0", 20, 0.9, "third parties as a service", r"make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", 20, 0.9, "not an open source license", r"the business source license (?:\S+ ){0,6}is not an open source license"),
    ("elastic-2.0", 20, 0.9, "hosted or managed service", r"you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", 20, 0.9, "commons clause", r"commons clause licen[sc]e condition"),
    ("commons-clause", 21, 0.85, "right to sell the software", r"the grant of rights under the licen[sc]e will not include and the licen[sc]e does not grant to you the right to sell the software"),
    ("proprietary", 44, 0.8, "via any medium", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited"),
    ("proprietary", 44, 0.8, "proprietary information of", r"this software is the confidential and proprietary information of"),
    ("proprietary", 47, 0.7, "licensed not sold", r"(?:the |this )?(?:software|product|program) is licensed not sold"),
    ("proprietary", 48, 0.6, "end user license agreement", r"end user license agreement"),
    ("proprietary", 48, 0.6, "trade secret", r"(?:contains|is) (?:a |the )?(?:valuable )?trade secrets? of"),
    ("proprietary", 48, 0.6, "internal use only", r"(?:confidential )?for internal use only"),
    ("restricted-rights", 46, 0.7, "restricted rights", r"(?:u s |us )?government (?:users )?restricted rights"),
    ("no-reproduction", 46, 0.7, "no part of this", r"no part of this (?:publication|book|document|work) may be reproduced"),
    ("no-reproduction", 47, 0.6, "reproduced distributed or transmitted", r"may not be reproduced distributed or transmitted in any form"),
    ("no-reproduction", 49, 0.5, "without the prior written", r"without the prior written (?:permission|consent) of the (?:copyright (?:holder|owner)|publisher|author)"),
    ("non-commercial", 47, 0.6, "commercial use only", r"(?:for )?(?:personal and )?non ?commercial use only"),
    ("non-commercial", 47, 0.6, "for personal use only", r"for personal use only"),
    ("non-commercial", 47, 0.6, "research purposes only", r"for (?:academic |scientific )?research purposes only"),
    ("non-commercial", 47, 0.6, "educational purposes only", r"for educational purposes only"),
    ("public-domain", 42, 0.6, "no rights reserved", r"no rights reserved"),
    ("public-domain", 41, 0.7, "no known copyright", r"no known copyright restrictions"),
    ("public-domain", 41, 0.7, "not subject to copyright", r"(?:work of the united states government|united states government work) (?:\S+ ){0,6}not subject to copyright"),
    ("some-rights-reserved", 60, 0.5, "some rights reserved", r"some rights reserved"),
    ("ogl", 20, 0.9, "open government licence", r"(?:contains public sector information licensed under the )?open government licence(?: v[123] 0)?"),
    ("crown", 50, 0.6, "crown copyright", r"crown copyright(?: (?:19|20)\d\d)?"),
    ("etalab-2.0", 20, 0.9, "licence ouverte", r"licence ouverte(?: open licence)?(?: version 2 0)?"),
    ("cdla", 20, 0.9, "community data license", r"community data license agreement (?:permissive|sharing)"),
    ("by-permission", 65, 0.4, "with permission", r"(?:reprinted|reproduced|used) with permission"),
    ("reserved", 60, 0.5, "rechte vorbehalten", r"alle rechte vorbehalten"),
    ("reserved", 60, 0.5, "droits r", r"tous droits réservés"),
    ("reserved", 60, 0.5, "derechos reservados", r"todos los derechos reservados"),
    ("reserved", 60, 0.5, "diritti riservati", r"tutti i diritti riservati"),
    ("copyright", 70, 0.3, "urheberrecht", r"urheberrechtlich geschützt"),
]
#: Forms in which a name is found: priority, strength, and the pattern around the name.
FORMS = [
    (30, 0.9, r"(?:licen[sc]ed|released|distributed|available|published|provided|covered|governed|redistributed) (?:under|by|with) (?:the )?(?:terms of )?(?:the )?(?:{0})"),
    (32, 0.85, r"(?:terms of|subject to|in accordance with|compliance with|pursuant to) (?:the )?(?:{0})"),
    (35, 0.6, r"(?:{0})"),
]
SPDX = r"spdx licen[sc]e identifier (?:{0})"

RULES = [
    *CLAUSES,
    *SENTENCES,
    *((label, priority, strength, key, form.format(name)) for label, key, name, _ in NAMES for priority, strength, form in FORMS),
    *((label, 10, 1.0, "identifier", SPDX.format(spdx)) for label, _, _, spdx in NAMES if spdx),
]

#: A text in which none of these words, or beginnings of words, stands can't match a rule or hold a base phrase.
GATE_WORDS = (
    "licen", "unlicen", "spdx", "cc", "copyright", "general", "rights", "public", "apache", "redistrib", "permission", "creativecommons", "warrant", "confidential",
    "advertising", "altered", "restriction", "gpl", "lgpl", "agpl", "contributor", "attribution", "bsd", "gnu", "mozilla", "foundation", "verbatim", "proprietary",
    "preferred", "convey", "version", "library", "remotely", "bison", "autoconf", "font", "llvm", "kernel", "liable", "endorse", "disclaims", "developed",
    "accompanying", "cddl", "mpl", "misrepresented", "anyone", "extent", "appropriate", "python", "php", "openssl", "toolkit", "cryptographic", "retain", "evil", "unicode",
    "png", "freetype", "jpeg", "patent", "parties", "sold", "secret", "internal", "reproduced", "written", "commercial", "noncommercial", "classpath", "personal", "research", "educational", "crown",
    "ouverte", "vorbehalten", "droits", "derechos", "diritti", "urheber", "medium", "proprietary",
)


def _either(words: list[str]) -> str:
    """A pattern for any of some words, common beginnings written once, so that few tries are made at a place."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words):
        heads.setdefault(w[:1], []).append(w[1:])
    if "" in heads:
        return ""
    parts = [head + _either(rest) for head, rest in heads.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


#: They are looked for at the beginnings of words.
GATE = f"(?i)(?:^|[^a-z]){_either(sorted(set(GATE_WORDS)))}"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _spaces(text: str) -> str:
    return f"(length({text}) - length(replace({text}, ' ', '')))"


def _whole(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


ITEM = "struct<start:int,minus_end:int,priority:int,label:string,strength:double>"
_ADD = "0, (a, x) -> a + x"
_TOP = "-1, (a, x) -> greatest(a, x)"


def _detections() -> str:
    """SQL for the detections of all rules in ``norm``: start word, minus end word, priority, label, strength."""
    table = "array(" + ", ".join(
        f"named_struct('label', {quoted(label)}, 'priority', {priority}, 'strength', {strength}D, 'key', {quoted(key)}, 'pattern', {quoted(_whole(pattern))})"
        for label, priority, strength, key, pattern in RULES
    ) + ")"
    # For each match: the words between the one before and it, its own words, and the place after it by block sums.
    gaps = f"transform(slice(split(norm, r.pattern, -1), 1, size(m)), p -> {_spaces('p')} - 1)"
    widths = f"transform(m, x -> {_spaces('x')} + 1)"
    sums = f"transform(sequence(0, size(v.w) div v.b), k -> aggregate(slice(v.g, k * v.b + 1, v.b), {_ADD}) + aggregate(slice(v.w, k * v.b + 1, v.b), {_ADD}))"
    done = "(i div v.b) * v.b + 1, i % v.b"
    start = f"aggregate(slice(s, 1, i div v.b), {_ADD}) + aggregate(slice(v.g, {done}), {_ADD}) + aggregate(slice(v.w, {done}), {_ADD}) + v.g[i]"
    hit = "named_struct('start', at, 'minus_end', -(at + n), 'priority', r.priority, 'label', r.label, 'strength', r.strength)"
    return f"""flatten(transform(
        filter({table}, r -> contains(norm, r.key)),
        r -> transform(array(regexp_extract_all(norm, r.pattern, 0)),
            m -> CASE WHEN size(m) = 0 THEN CAST(array() AS array<{ITEM}>) ELSE
              transform(array(named_struct('g', {gaps}, 'w', {widths}, 'b', greatest(1, cast(sqrt(size(m)) AS int)))),
                v -> transform(array({sums}),
                  s -> transform(v.w, (n, i) -> transform(array({start}), at -> {hit})[0]))[0])[0] END)[0]))"""


def _with_kept(df: DataFrame) -> DataFrame:
    """Add ``detections``: those of ``found`` that stay, sorted."""
    df = with_computed(df, "sorted", f"CASE WHEN size(found) > 0 THEN sort_array(found) ELSE CAST(array() AS array<{ITEM}>) END")
    df = with_computed(df, "ends", "transform(sorted, d -> -d.minus_end)")
    df = with_computed(df, "block", "greatest(1, cast(sqrt(size(ends)) AS int))")
    df = with_computed(df, "tops", f"transform(sequence(0, size(ends) div block), k -> aggregate(slice(ends, k * block + 1, block), {_TOP}))")
    before = f"greatest(aggregate(slice(tops, 1, i div block), {_TOP}), aggregate(slice(ends, (i div block) * block + 1, i % block), {_TOP}))"
    df = with_computed(df, "outer_ones", f"filter(sorted, (d, i) -> {before} < -d.minus_end)")
    return with_computed(
        df, "detections",
        """filter(outer_ones, (d, i) ->
            NOT coalesce(-get(outer_ones, i - 1).minus_end > d.start AND get(outer_ones, i - 1).priority <= d.priority, false)
            AND NOT coalesce(get(outer_ones, i + 1).start < -d.minus_end AND get(outer_ones, i + 1).priority < d.priority, false))""",
    )


def scanned(docs: DataFrame) -> DataFrame:
    """Each row's word counts, base places and the kept ``detections``."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    df = with_computed(
        df, "norm",
        f"CASE WHEN text RLIKE {quoted(GATE)} THEN ' ' || trim(regexp_replace(translate(text, '{upper}', '{lower}'), {quoted(_NOT_WORD)}, ' ')) || ' ' ELSE '' END",
    ).selectExpr("doc_id", "norm", f"CASE WHEN norm = '' THEN regexp_count(text, {quoted(_ANY_CASE_WORD)}) WHEN norm = '  ' THEN 0 ELSE {_spaces('norm')} - 1 END AS n_words")
    base = quoted(_whole("|".join(BASE)))
    places = f"CASE WHEN {' OR '.join(f'contains(norm, {quoted(f" {p} ")})' for p in BASE)} THEN named_struct('pieces', split(norm, {base}, -1), 'hits', regexp_extract_all(norm, {base}, 0)) END"
    df = with_computed(df, "base", places)
    df = with_computed(df, "found", f"CASE WHEN norm <> '' THEN {_detections()} END")
    return _with_kept(df).selectExpr("doc_id", "cast(n_words AS bigint) AS n_words", "base", "detections")


def licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row."""
    names = "map(" + ", ".join(f"{quoted(p)}, {quoted(label)}" for p, label in BASE.items()) + ")"
    df = scanned(docs).selectExpr(
        "*", f"coalesce(array_sort(array_distinct(transform(base.hits, h -> element_at({names}, h)))), CAST(array() AS array<string>)) AS of_base",
    )
    return df.selectExpr(
        "doc_id", "n_words", "cast(size(coalesce(base.hits, CAST(array() AS array<string>))) AS bigint) AS n_base",
        f"cast({_spaces('base.pieces[0]')} - 1 AS bigint) AS first_word",
        f"cast(n_words - ({_spaces('element_at(base.pieces, -1)')} - 1) - ({_spaces('element_at(base.hits, -1)')} + 1) AS bigint) AS last_word",
        "array_join(of_base, ',') AS base_labels",
        "array_join(array_sort(array_distinct(of_base || transform(detections, d -> d.label))), ',') AS labels",
        "coalesce(array_max(transform(detections, d -> d.strength)), 0D) AS score",
    )
