"""Licence scan: ordered signature rules behind a keyword prefilter.

A text is normalised to words (A-Z lower-cased; runs of digits, a-z and non-ASCII characters), joined by
single blanks. Every rule is a regular expression over that form, has a keyword that any match must contain,
a label, a priority and a confidence. A rule runs only on texts that hold its keyword. Detections are taken by rank,
then the longer, then the earlier one first. One that lies inside a kept one is suppressed; one around kept ones goes
too, unless all have its label: then it takes their place. What is left gives the labels. The three base phrases are
counted at all their places and are never suppressed.

The rules: every line of NAMES, FORMS and TEXTS is written by hand. A name is a rule where it says "licence" itself,
and is one with each of the forms in which licences are invoked; a sentence is a rule as it is.

Null or empty text: no words, no labels, null places, score 0. The work on a text is in proportion to its length and
its number of detections, which are held in arrays. Rows are mapped one by one: repeated rows repeat in the result,
null ids stay, extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from markloom.llm.common import WORD_BYTES, slices

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, "
    "base_labels string, labels string, score double, spans array<struct<start:int,stop:int,label:string>>"
)
#: Phrase and label of the contract.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Hand-written: label, keyword, and the ways a licence is named, over normalised words. An optional version follows
#: "~" as a group of its own, so that "apache 2.0" and "apache" become two rules with two labels.
NAMES: list[tuple[str, str, list[str]]] = [
    ("mit", "mit", ["mit", "the mit", "expat", "mit expat", "x11 mit"]),
    ("apache-2.0", "apache", ["apache 2 0", "apache v2(?: 0)?", "apache license (?:version |v )?2 0", "apache software license (?:version |v )?2 0", "asl 2 0"]),
    ("apache-1.1", "apache", ["apache 1 1", "apache (?:software )?license (?:version )?1 1"]),
    ("apache-1.0", "apache", ["apache 1 0", "apache (?:software )?license (?:version )?1 0"]),
    ("apache", "apache", ["apache", "apache software"]),
    ("gpl-3.0", "gpl", ["gpl ?v?3(?: 0)?", "gnu gpl (?:version |v )?3(?: 0)?", "gplv3"]),
    ("gpl-2.0", "gpl", ["gpl ?v?2(?: 0)?", "gnu gpl (?:version |v )?2(?: 0)?", "gplv2"]),
    ("gpl-3.0", "general public", ["gnu general public license (?:version |v )?3(?: 0)?", "general public license (?:version |v )?3(?: 0)?"]),
    ("gpl-2.0", "general public", ["gnu general public license (?:version |v )?2(?: 0)?", "general public license (?:version |v )?2(?: 0)?"]),
    ("gpl", "general public", ["gnu general public license", "gnu general public"]),
    ("agpl-3.0", "affero", ["gnu affero general public license(?: (?:version |v )?3(?: 0)?)?", "affero general public license(?: (?:version |v )?3)?", "affero gpl"]),
    ("agpl-3.0", "agpl", ["agpl ?v?3(?: 0)?", "gnu agpl", "agplv3"]),
    ("lgpl-3.0", "lesser", ["gnu lesser general public license (?:version |v )?3(?: 0)?", "lesser general public license (?:version |v )?3"]),
    ("lgpl-2.1", "lesser", ["gnu lesser general public license (?:version |v )?2 1", "lesser general public license (?:version |v )?2 1"]),
    ("lgpl-2.0", "library general", ["gnu library general public license(?: (?:version |v )?2(?: 0)?)?"]),
    ("lgpl", "lgpl", ["lgpl ?v?3(?: 0)?", "lgpl ?v?2 1", "gnu lgpl", "lgpl"]),
    ("bsd-2-clause", "bsd", ["bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd"]),
    ("bsd-3-clause", "bsd", ["bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd"]),
    ("bsd-4-clause", "bsd", ["bsd 4 clause", "4 clause bsd", "original bsd"]),
    ("0bsd", "bsd", ["0bsd", "zero clause bsd", "bsd zero clause"]),
    ("bsd", "bsd", ["bsd", "berkeley software distribution bsd", "bsd style"]),
    ("isc", "isc", ["isc", "internet systems consortium isc"]),
    ("mpl-2.0", "mozilla", ["mozilla public license (?:version |v )?2 0", "mozilla public license v2"]),
    ("mpl-1.1", "mozilla", ["mozilla public license (?:version |v )?1 1"]),
    ("mpl", "mpl", ["mpl ?v?2(?: 0)?", "mpl ?v?1 1", "mplv2"]),
    ("epl-2.0", "eclipse", ["eclipse public license (?:version |v )?2(?: 0)?"]),
    ("epl-1.0", "eclipse", ["eclipse public license (?:version |v )?1(?: 0)?", "eclipse public license"]),
    ("edl-1.0", "eclipse", ["eclipse distribution license(?: (?:version |v )?1 0)?"]),
    ("cddl", "cddl", ["cddl 1 0", "cddl 1 1", "cddl"]),
    ("cddl", "common development", ["common development and distribution license"]),
    ("cpl-1.0", "common public", ["common public license(?: (?:version |v )?1 0)?"]),
    ("artistic-2.0", "artistic", ["artistic license 2 0", "artistic 2 0", "perl artistic 2 0"]),
    ("artistic-1.0", "artistic", ["artistic license", "perl artistic"]),
    ("boost-1.0", "boost", ["boost software license(?: (?:version )?1 0)?", "boost software"]),
    ("zlib", "zlib", ["zlib", "zlib libpng"]),
    ("libpng", "libpng", ["libpng", "png reference library"]),
    ("unlicense", "unlicense", ["unlicense", "the unlicense"]),
    ("wtfpl", "wtfpl", ["wtfpl", "wtfpl 2"]),
    ("eupl", "eupl", ["eupl 1 1", "eupl 1 2", "eupl"]),
    ("eupl", "european union public", ["european union public licen[cs]e(?: (?:v |version )?1 [12])?"]),
    ("cecill", "cecill", ["cecill b", "cecill c", "cecill 2 1", "cecill"]),
    ("osl-3.0", "open software", ["open software license(?: (?:v |version )?3 0)?"]),
    ("afl-3.0", "academic free", ["academic free license(?: (?:v |version )?3 0)?"]),
    ("ms-pl", "microsoft", ["microsoft public", "microsoft public license"]),
    ("ms-rl", "microsoft", ["microsoft reciprocal", "microsoft reciprocal license"]),
    ("ncsa", "ncsa", ["ncsa", "university of illinois ncsa", "illinois ncsa open source"]),
    ("postgresql", "postgresql", ["postgresql", "postgresql license"]),
    ("python-2.0", "python", ["python software foundation", "psf", "python 2 0"]),
    ("ruby", "ruby", ["ruby license"]),
    ("php-3.01", "php", ["php 3 01", "php license"]),
    ("vim", "vim", ["vim license"]),
    ("ofl-1.1", "open font", ["sil open font license(?: 1 1)?", "open font license(?: (?:version )?1 1)?"]),
    ("upl-1.0", "universal permissive", ["universal permissive license(?: (?:v |version )?1 0)?"]),
    ("odbl-1.0", "open database", ["open database license(?: (?:v |version )?1 0)?", "odc open database license"]),
    ("odc-by", "open data commons", ["open data commons attribution(?: license)?"]),
    ("pddl", "public domain dedication", ["public domain dedication and licen[cs]e", "odc public domain dedication"]),
    ("gfdl", "free documentation", ["gnu free documentation license(?: (?:version )?1 [123])?", "free documentation license"]),
    ("blue-oak", "blue oak", ["blue oak model license(?: 1 0 0)?"]),
    ("bsl-1.1", "business source", ["business source license(?: 1 1)?"]),
    ("sspl-1.0", "server side", ["server side public license(?: (?:v |version )?1)?"]),
    ("elastic-2.0", "elastic", ["elastic license(?: 2 0)?", "elastic 2 0"]),
    ("openrail-m", "openrail", ["openrail m", "openrail", "creativeml openrail m"]),
    ("cc0-1.0", "cc0", ["cc0 1 0", "cc0", "creative commons zero"]),
    ("cc-by", "cc by", ["cc by(?: [1-4] 0)?", "cc by attribution"]),
    ("cc-by-sa", "cc by sa", ["cc by sa(?: [1-4] 0)?"]),
    ("cc-by-nc", "cc by nc", ["cc by nc(?: [1-4] 0)?"]),
    ("cc-by-nd", "cc by nd", ["cc by nd(?: [1-4] 0)?"]),
    ("cc-by-nc-sa", "cc by nc sa", ["cc by nc sa(?: [1-4] 0)?"]),
    ("cc-by-nc-nd", "cc by nc nd", ["cc by nc nd(?: [1-4] 0)?"]),
    ("cc-by", "creative commons", ["creative commons attribution(?: [1-4] 0)?(?: international)?"]),
    ("cc-by-sa", "creative commons", ["creative commons attribution share ?alike(?: [1-4] 0)?(?: international)?"]),
    ("cc-by-nc", "creative commons", ["creative commons attribution non ?commercial(?: [1-4] 0)?(?: international)?"]),
    ("cc-by-nd", "creative commons", ["creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] 0)?(?: international)?"]),
    ("cc-by-nc-sa", "creative commons", ["creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?"]),
    ("cc-by-nc-nd", "creative commons", ["creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] 0)?"]),
]
#: How a licence is invoked: template, extra rank, confidence. A longer, more explicit form outranks a bare name.
FORMS: list[tuple[str, int, float]] = [
    ("spdx license identifier {}", 30, 1.0),
    ("(?:is |are |was |work is )?(?:licensed|released|distributed|published|available|provided|dual licensed) under (?:the )?(?:terms of (?:the )?)?{}(?: public)?(?: licen[cs]e)?(?: (?:version |v )?\\d(?: \\d)?)?", 20, 0.95),
    ("(?:subject to|governed by|covered by|under the terms of) (?:the )?{}(?: licen[cs]e)?", 15, 0.9),
    ("licen[cs]e (?:is )?(?:the )?{}", 10, 0.8),
    ("{} licen[cs]e", 5, 0.7),
]
#: Whole sentences of licence texts: label, keyword, pattern, confidence. They outrank names.
TEXTS: list[tuple[str, str, str, float]] = [
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("mit", "copies or substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", 1.0),
    ("apache-2.0", "compliance with the license", "you may not use this file except in compliance with the license", 0.9),
    ("apache-2.0", "apache org licenses", "www apache org licenses license 2 0", 1.0),
    ("gpl", "redistribute it", "you can redistribute it and or modify it under the terms of the gnu general public license", 1.0),
    ("gpl", "gnu org licenses", "www gnu org licenses(?: gpl(?: 3 0| 2 0)?)?", 0.8),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd-3-clause", "neither the name", "neither the name of .{0,200}? may be used to endorse or promote products", 1.0),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software", 1.0),
    ("isc", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee", 1.0),
    ("zlib", "as is without any express", "this software is provided as is without any express or implied warranty in no event", 0.9),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public license", 1.0),
    ("boost-1.0", "distributed under the boost", "distributed under the boost software license version 1 0", 1.0),
    ("unlicense", "released into the public", "this is free and unencumbered software released into the public domain", 1.0),
    ("public-domain", "public domain", "(?:is in|dedicated to|released into|placed in(?:to)?) the public domain", 0.8),
    ("wtfpl", "what the fuck", "do what the fuck you want to public license", 1.0),
    ("cc0-1.0", "waived all copyright", "has waived all copyright and related", 1.0),
    ("cc-by", "creativecommons org licenses by", "creativecommons org licenses by [1-4] 0", 1.0),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons org licenses by sa [1-4] 0", 1.0),
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons org licenses by nc [1-4] 0", 1.0),
    ("cc0-1.0", "creativecommons org publicdomain", "creativecommons org publicdomain zero 1 0", 1.0),
    ("proprietary", "all rights reserved", "all rights reserved", 0.5),
    ("proprietary", "confidential", "confidential and proprietary", 0.6),
    # fixed values: sentences of published licences
    ("mit", "without restriction", "to deal in the software without restriction including without limitation the rights", 1.0),
    ("mit", "provided as is", "the software is provided as is without warranty of any kind express or implied including but not limited to", 0.8),
    ("mit", "authors or copyright holders", "in no event shall the authors or copyright holders be liable for any claim", 0.9),
    ("mit-0", "mit no attribution", "mit no attribution(?: licen[cs]e)?", 1.0),
    ("x11", "advertising or otherwise", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", 1.0),
    ("apache-2.0", "licensed under the apache", "licensed under the apache license version 2 0 the license", 1.0),
    ("apache-2.0", "limitations under the license", "see the license for the specific language governing permissions and limitations under the license", 0.9),
    ("apache-2.0", "apache license version", "apache license version 2 0 january 2004", 1.0),
    ("apache-2.0", "reproduction and distribution", "terms and conditions for use reproduction and distribution", 0.8),
    ("apache-2.0", "irrevocable copyright license", "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 0.9),
    ("apache-1.1", "developed by the apache", "this product includes software developed by the apache (?:software foundation|group)", 1.0),
    ("apache-1.1", "names apache", "the names apache (?:server )?and apache (?:software foundation|group) must not be used", 1.0),
    ("gpl", "free software foundation", "as published by the free software foundation", 0.8),
    ("gpl-3.0", "either version 3", "either version 3 of the license or at your option any later version", 0.9),
    ("gpl-2.0", "either version 2", "either version 2 of the license or at your option any later version", 0.9),
    ("gpl", "hope that it will be useful", "in the hope that it will be useful but without any warranty", 0.8),
    ("gpl", "should have received a copy", "you should have received a copy of the gnu general public license along with", 1.0),
    ("gpl-3.0", "29 june 2007", "gnu general public license version 3 29 june 2007", 1.0),
    ("gpl-2.0", "june 1991", "gnu general public license version 2 june 1991", 1.0),
    ("gpl-1.0", "february 1989", "gnu general public license version 1 february 1989", 1.0),
    ("gpl", "share and change", "guarantee your freedom to share and change (?:all versions of a program|free software)", 0.9),
    ("gpl-2.0-classpath", "as a special exception", "as a special exception the copyright holders of this library give you permission to link this library with independent modules", 1.0),
    ("gpl-3.0-gcc", "runtime library exception", "gcc runtime library exception(?: version 3 1)?", 1.0),
    ("agpl-3.0", "19 november 2007", "gnu affero general public license version 3 19 november 2007", 1.0),
    ("agpl-3.0", "remotely through a computer network", "interacting with it remotely through a computer network", 0.9),
    ("agpl-1.0", "affero general public", "affero general public license version 1(?: 0)?", 1.0),
    ("lgpl-2.1", "february 1999", "gnu lesser general public license version 2 1 february 1999", 1.0),
    ("lgpl-2.0", "library general public", "gnu library general public license version 2 june 1991", 1.0),
    ("lgpl-3.0", "supplemented by the additional", "terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions", 1.0),
    ("lgpl", "work that uses the library", "is called a work that uses the library", 0.9),
    ("gfdl", "invariant sections", "with no invariant sections(?: no front cover texts and no back cover texts)?", 1.0),
    ("gfdl", "copy distribute and or modify this document", "permission is granted to copy distribute and or modify this document", 1.0),
    ("bsd", "retain the above copyright", "redistributions of source code must retain the above copyright notice this list of conditions", 0.9),
    ("bsd", "binary form must reproduce", "redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd", "copyright holders and contributors", "this software is provided by the copyright holders and contributors as is", 0.8),
    ("bsd", "regents and contributors", "this software is provided by the regents and contributors as is", 0.9),
    ("bsd-3-clause", "names of its contributors", "(?:nor )?(?:the )?names of its contributors may be used to endorse or promote products", 1.0),
    ("bsd-3-clause-clear", "no express or implied licenses", "no express or implied licenses to any party s patent rights are granted", 1.0),
    ("bsd-3-clause-no-nuclear", "nuclear facility", "not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", 1.0),
    ("bsd-4-clause", "university of california berkeley", "this product includes software developed by the university of california berkeley", 1.0),
    ("bsd-2-clause-views", "views and conclusions", "the views and conclusions contained in the software and documentation are those of the authors", 1.0),
    ("bsd-2-clause-patent", "bsd 2 clause plus patent", "bsd 2 clause plus patent", 1.0),
    ("0bsd", "use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)", 0.9),
    ("isc", "author disclaims all warranties", "the author disclaims all warranties with regard to this software", 0.9),
    ("hpnd", "without fee is hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", 1.0),
    ("ntp", "suitability of this software for any purpose", "makes no representations about the suitability of this software for any purpose", 0.9),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented", 1.0),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such", 1.0),
    ("libpng", "png reference library", "the png reference library is supplied as is", 1.0),
    ("ijg", "independent jpeg group", "this software is based in part on the work of the independent jpeg group", 1.0),
    ("ftl", "freetype project", "the freetype project license|portions of this software are copyright .{0,60}? the freetype project", 1.0),
    ("curl", "curl license", "curl license|copyright .{0,40}? daniel stenberg", 0.9),
    ("openssl", "openssl toolkit", "for use in the openssl toolkit", 1.0),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young", 1.0),
    ("unicode", "unicode data files", "any person obtaining a copy of the unicode data files", 1.0),
    ("icu", "icu license", "icu license(?: icu 1 8 1 and later)?", 1.0),
    ("w3c", "w3c software", "w3c (?:r )?software (?:and document )?notice(?: and license)?", 1.0),
    ("json", "good not evil", "the software shall be used for good not evil", 1.0),
    ("beerware", "buy me a beer", "you can buy me a beer in return", 1.0),
    ("wtfpl", "wtfpl", "wtfpl version 2 december 2004", 1.0),
    ("mpl-2.0", "mozilla org mpl", "you can obtain one at https? mozilla org mpl 2 0", 1.0),
    ("mpl-1.1", "mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("mpl-2.0-no-copyleft", "incompatible with secondary", "incompatible with secondary licenses as defined by the mozilla public license", 1.0),
    ("npl-1.1", "netscape public", "netscape public license(?: version 1 [01])?", 1.0),
    ("epl-1.0", "eclipse org legal", "www eclipse org legal epl v10(?: html)?", 1.0),
    ("epl-2.0", "eclipse org legal", "(?:www )?eclipse org legal epl 2 0", 1.0),
    ("epl", "accompanying program is provided", "the accompanying program is provided under the terms of this eclipse public license", 1.0),
    ("cpl-1.0", "accompanying program is provided", "the accompanying program is provided under the terms of this common public license", 1.0),
    ("ipl-1.0", "ibm public", "ibm public license(?: version 1 0)?", 1.0),
    ("cddl", "cddl", "subject to the terms of the common development and distribution license", 1.0),
    ("artistic-1.0", "artistic", "the artistic license preamble", 1.0),
    ("artistic-2.0", "artistic", "the artistic license 2 0 copyright", 1.0),
    ("perl-5", "same terms as perl", "(?:redistribute it and or modify it )?under the same terms as perl(?: itself)?", 1.0),
    ("boost-1.0", "boost org", "(?:www )?boost org license 1 0 txt", 1.0),
    ("boost-1.0", "machine executable object code", "solely in the form of machine executable object code generated by a source language processor", 1.0),
    ("ms-pl", "microsoft public license", "this license governs use of the accompanying software .{0,120}? microsoft public license", 0.9),
    ("ms-lpl", "microsoft limited public", "microsoft limited public license", 1.0),
    ("ncsa", "university of illinois", "university of illinois(?: ncsa)? open source license", 1.0),
    ("postgresql", "postgresql", "postgresql database management system formerly known as postgres", 1.0),
    ("python-2.0", "python software foundation license", "python software foundation license version 2", 1.0),
    ("cnri-python", "cnri", "cnri (?:open source )?(?:license|licence) agreement", 1.0),
    ("ruby", "ruby s license", "(?:same terms as|under) ruby s license|same terms as ruby(?: itself)?", 1.0),
    ("php-3.01", "php net software", "this product includes php software freely available from", 1.0),
    ("zend-2.0", "zend engine", "the zend engine license(?: version 2 00)?", 1.0),
    ("tcl", "tcl tk license", "tcl tk license(?: terms)?", 1.0),
    ("ofl-1.1", "reserved font name", "with reserved font names?", 0.9),
    ("ofl-1.1", "scripts sil org", "scripts sil org ofl", 1.0),
    ("bitstream-vera", "bitstream vera", "bitstream vera is a trademark of bitstream", 1.0),
    ("cc0-1.0", "cc0 1 0 universal", "cc0 1 0 universal(?: cc0 1 0)?(?: public domain dedication)?", 1.0),
    ("cc0-1.0", "no copyright", "the person who associated a work with this deed has dedicated the work to the public domain", 1.0),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons org licenses by nd [1-4] 0", 1.0),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa [1-4] 0", 1.0),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd [1-4] 0", 1.0),
    ("cc-pdm", "creativecommons org publicdomain mark", "creativecommons org publicdomain mark 1 0", 1.0),
    ("odbl-1.0", "opendatacommons org", "opendatacommons org licenses odbl(?: 1 0)?", 1.0),
    ("odc-by", "opendatacommons org", "opendatacommons org licenses by(?: 1 0)?", 1.0),
    ("pddl", "opendatacommons org", "opendatacommons org licenses pddl(?: 1 0)?", 1.0),
    ("ogl-uk", "open government", "(?:uk )?open government licen[cs]e(?: v(?:ersion )?[123](?: 0)?)?", 1.0),
    ("etalab", "etalab", "licence ouverte(?: open licence)?|etalab 2 0", 1.0),
    ("dl-de", "datenlizenz deutschland", "datenlizenz deutschland (?:namensnennung|zero)(?: 2 0)?", 1.0),
    ("cdla-permissive", "community data license", "community data license agreement permissive(?: (?:version )?[12] 0)?", 1.0),
    ("cdla-sharing", "community data license", "community data license agreement sharing(?: (?:version )?1 0)?", 1.0),
    ("sspl-1.0", "mongodb", "server side public license version 1 october 16 2018", 1.0),
    ("bsl-1.1", "change date", "(?:change date|additional use grant) .{0,120}? change license", 0.8),
    ("elastic-2.0", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service", 1.0),
    ("commons-clause", "commons clause", "commons clause license condition(?: v1 0)?", 1.0),
    ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use)(?: license)?(?: 1 0 0)?", 1.0),
    ("prosperity", "prosperity public", "the prosperity public license(?: 3 0 0)?", 1.0),
    ("parity", "parity public", "the parity public license(?: 7 0 0)?", 1.0),
    ("blue-oak", "blueoakcouncil", "blueoakcouncil org license 1 0 0", 1.0),
    ("hippocratic", "hippocratic", "hippocratic license(?: (?:version )?[123] [01])?", 1.0),
    ("openrail-m", "use based restrictions", "use based restrictions as referenced in paragraph 5", 0.9),
    ("llama", "llama", "llama [1-4](?: [0-9])? community license(?: agreement)?", 1.0),
    ("mulan-psl", "mulan", "mulan (?:psl|permissive software license)(?: v(?:ersion )?[12])?", 1.0),
    ("eupl", "european union public", "licensed under the eupl(?: version 1 [12])?|european union public licence v 1 [12]", 1.0),
    ("cecill", "cecill", "ce logiciel est regi par la licence cecill|governed by the cecill(?: [bc])? license", 1.0),
    ("cern-ohl", "cern open hardware", "cern open hardware licen[cs]e(?: version 2)?(?: (?:strongly reciprocal|weakly reciprocal|permissive))?", 1.0),
    ("tapr-ohl", "tapr open hardware", "tapr open hardware license(?: 1 0)?", 1.0),
    ("solderpad", "solderpad", "solderpad hardware license(?: v(?:ersion )?[02] [51])?", 1.0),
    ("afl-3.0", "academic free license", "licensed under the academic free license version 3 0", 1.0),
    ("osl-3.0", "open software license", "licensed under the open software license version 3 0", 1.0),
    ("ecl-2.0", "educational community", "educational community license(?: version)? 2 0", 1.0),
    ("lppl", "latex project public", "latex project public license(?: (?:either )?version 1 [0-3]c?)?", 1.0),
    ("qpl", "q public", "q public license(?: version 1 0)?", 1.0),
    ("sleepycat", "sleepycat", "the sleepycat license|sleepycat software", 0.9),
    ("nasa-1.3", "nasa open source", "nasa open source agreement(?: version 1 3)?", 1.0),
    ("public-domain", "no copyright", "no copyright is claimed(?: in the united states)?", 0.7),
    ("public-domain", "not subject to copyright", "(?:is|are) not subject to copyright protection", 0.7),
    ("public-domain", "public domain", "(?:hereby )?(?:disclaims copyright to|waives? all rights to) this (?:source code|work)", 0.6),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited", 1.0),
    ("proprietary", "may not be reproduced", "may not be reproduced (?:or |distributed )?.{0,80}? without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)", 0.8),
    ("proprietary", "trade secrets", "contains (?:valuable )?(?:confidential information and )?trade secrets of", 0.8),
    ("proprietary", "evaluation purposes", "(?:for|solely for) evaluation purposes only", 0.6),
    ("non-commercial", "non commercial", "(?:for|free for) non ?commercial (?:use|purposes)(?: only)?", 0.6),
    ("research-only", "research purposes", "(?:for|solely for) (?:academic |non commercial )?research purposes only", 0.6),
    ("unlicense", "unlicense org", "(?:for more information )?(?:please refer to )?(?:https? )?unlicense org", 1.0),
    ("unlicense", "copy modify publish use compile", "anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("isc", "copyright notice and this permission notice appear", "provided that the above copyright notice and this permission notice appear in all copies", 0.9),
    ("adobe", "adobe systems", "adobe (?:systems incorporated )?source code license agreement", 1.0),
    ("intel", "intel open source", "intel open source license(?: for cdsa)?", 1.0),
    ("sun-bcl", "binary code license", "(?:sun microsystems|oracle) .{0,40}? binary code license agreement", 1.0),
    ("afmparse", "afm parse", "this file may be freely copied and redistributed as long as", 0.8),
    ("fsf-unlimited", "unlimited permission", "gives unlimited permission to copy and or distribute it", 1.0),
    ("fsf-all-permissive", "copying and distribution of this file", "copying and distribution of this file with or without modification are permitted in any medium without royalty", 1.0),
]


def literals(pattern: str) -> list[str]:
    """The stretches of a pattern that any match must hold: without groups, classes and what may be left out."""
    while (less := re.sub(r"\((?:\?:)?[^()]*\)\??|\[[^]]*\]\??", "\0", pattern)) != pattern:
        pattern = less
    return re.split(r"\0+", re.sub(r".\?|\\.\??|\.\{[^}]*\}\??", "\0", pattern))


def alternatives(pattern: str) -> list[str]:
    """A pattern cut at the bars that stand in no group."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def gate(key: str, pattern: str) -> str:
    """The keyword, or where the pattern doesn't hold it, its own longest word."""
    sure = literals(pattern)
    return key if any(key in x for x in sure) else max(" ".join(sure).split(), key=len)


@lru_cache(maxsize=1)
def rules() -> dict[bytes, list[tuple[int, re.Pattern, str, float]]]:
    """Rules by keyword: (rank, pattern, label, confidence). A pattern takes the blank before the words, not the one behind."""
    out: dict[bytes, list[tuple[int, re.Pattern, str, float]]] = {}

    def add(rank: int, key: str, name: str, pattern: str, label: str, sure: float) -> None:
        out.setdefault(gate(key, name).encode(), []).append((rank, re.compile(f" (?:{pattern})(?= )".encode()), label, sure))

    for label, key, pattern, sure in TEXTS:
        for one in alternatives(pattern):
            add(1000, key, one, one, label, sure)
    for label, key, names in NAMES:
        for name in names:
            for form, rank, sure in FORMS:
                if not (form.startswith("{}") and re.search(r"licen\S*(?: |\(|$)", name.split(" (?:")[0])):
                    add(rank * 10 + ("\\d" in name or " 0" in name), key, name, form.format(f"(?:{name})"), label, sure)
            if " " in name and "licen" in name:
                add(40, key, name, name, label, 0.7)
    return out


def detections(norm: bytes) -> Iterable[tuple[int, int, int, str, float]]:
    """Rank, byte start, byte end, label, confidence of every rule's matches in b" words ", in the order in which they count."""
    found: list[np.ndarray] = []
    said: list[tuple[str, float]] = []
    for key, own in rules().items():
        if key in norm:
            for rank, pattern, label, sure in own:
                spans = np.array([m.span() for m in pattern.finditer(norm)], np.int64)
                if len(spans):
                    found.append(np.column_stack([np.full(len(spans), -rank), spans[:, 0] + 1, spans[:, 1], np.full(len(spans), len(said))]))
                    said.append((label, sure))
    if not found:
        return []
    rank, a, b, rule = np.concatenate(found).T
    by_name = np.argsort(np.argsort(np.array([f"{label}\0{sure}" for label, sure in said]), kind="stable"))
    order = np.lexsort((by_name[rule], a, a - b, rank))
    return ((r, x, y, *said[k]) for r, x, y, k in zip(*(v[order].tolist() for v in (-rank, a, b, rule)), strict=True))


class Kept:
    """Intervals (start, end, label, confidence), none of which contains another: in cells by their starts, each sorted."""

    CELL = 256

    def __init__(self):
        self.cells: dict[int, list[tuple[int, int, str, float]]] = {}
        self.longest = 0

    def take(self, a: int, b: int, label: str, sure: float) -> None:
        cells, first = self.cells, a // self.CELL
        for c in range(first, max((b - self.longest) // self.CELL - 1, -1), -1):  # the last one that begins up to here
            if (own := cells.get(c)) and (i := bisect_left(own, (a + 1,))):
                if own[i - 1][1] >= b:
                    return
                break
        inside = []
        for c in range(first, b // self.CELL + 1):
            if own := cells.get(c):
                i = bisect_left(own, (a,))
                while i < len(own) and own[i][1] <= b:
                    if own[i][2] != label:
                        return
                    inside.append(own[i])
                    i += 1
                if i < len(own):  # it ends later, and so do all that begin later
                    break
        for x in inside:
            cells[x[0] // self.CELL].remove(x)
            sure = max(sure, x[3])
        insort(cells.setdefault(first, []), (a, b, label, sure))
        self.longest = max(self.longest, b - a)

    def all(self) -> list[tuple[int, int, str, float]]:
        return [x for c in sorted(self.cells) for x in self.cells[c]]


def scan(norm: bytes) -> tuple[list[tuple[int, int, str, float]], list[int], list[str]]:
    """Kept detections (byte start, byte end, label, confidence) in b" words " , base places, base labels."""
    places, base = [], []
    for phrase, label in BASE:
        needle, at = b" " + phrase.encode() + b" ", -1
        while (at := norm.find(needle, at + 1)) >= 0:
            places.append(at)
            if label not in base:
                base.append(label)
    kept = Kept()
    for _, a, b, label, sure in detections(norm):
        kept.take(a, b, label, sure)
    return kept.all(), places, base


def _scan_batches(with_spans: bool):
    long, text = pa.int64(), pa.string()
    kinds = [long, long, long, long, long, text, text, pa.float64()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    if with_spans:
        kinds.append(pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("label", text)])))
        names.append("spans")

    def run(batches):
        for b in slices(batches, "text"):
            out: list[list] = [[] for _ in names]
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                norm = b" ".join((t or b"").translate(WORD_BYTES).split())
                n = norm.count(b" ") + 1 if norm else 0
                padded = b" " + norm + b" "
                kept, places, base = scan(padded) if n else ([], [], [])
                word = None
                if places or (with_spans and kept):
                    blanks = np.flatnonzero(np.frombuffer(padded, np.uint8) == 32)
                    word = lambda x, blanks=blanks: int(np.searchsorted(blanks, x))
                ends = [word(min(places)), word(max(places))] if places else [None, None]
                labels = sorted({*base, *(lab for _, _, lab, _ in kept)})
                score = max([0.0, *(s for _, _, _, s in kept), *([0.7] if base else [])])
                row = [i, n, len(places), *ends, ",".join(sorted(base)), ",".join(labels), score]
                if with_spans:
                    row.append([{"start": word(x) - 1, "stop": word(y), "label": lab} for x, y, lab, _ in kept])
                for k, v in zip(out, row, strict=True):
                    k.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)

    return run


def license_scan(docs: DataFrame, spans: bool = True) -> DataFrame:
    """doc_id and text to word counts, base places, labels, score and, if asked for, the spans (word positions) kept."""
    schema = SCHEMA if spans else SCHEMA[: SCHEMA.index(", spans")]
    return docs.select("doc_id", "text").mapInArrow(_scan_batches(spans), schema)
