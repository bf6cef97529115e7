"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters; rules are regexes over the
words joined by single spaces, one for each license name, version or sentence of a license's own text. Keywords gate
them: a rule runs only where its keyword is in the text, so most texts cost a few substring searches. A name that a
notice introduces ("licensed under the ...") is extended to the notice's first word and takes its priority.

Detections are intervals of words. In order of priority, then length, then place, a detection stands unless it lies
within one that stands already; overlaps that don't contain each other both stand. What lies within a detection that
fell lies within the one that felled it, so one sweep by start for each priority, with the furthest end so far, decides.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.textarrays import ALNUM, Words, fold

#: The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_V = "(?: version)?"
_LATER = " (?:or (?:at your option )?(?:any )?later(?: version)?|or newer)"
#: label, keyword, name: each license's names, as words.
NAMES: list[tuple[str, str, str]] = [
    ("gpl-1.0", "general public", rf"gnu general public licen[cs]e{_V} v? ?1(?: 0)?"),
    ("gpl-2.0", "general public", rf"gnu general public licen[cs]e{_V} v? ?2(?: 0)?"),
    ("gpl-3.0", "general public", rf"gnu general public licen[cs]e{_V} v? ?3(?: 0)?"),
    ("gpl-2.0-or-later", "general public", rf"gnu general public licen[cs]e{_V} v? ?2(?: 0)?{_LATER}"),
    ("gpl-3.0-or-later", "general public", rf"gnu general public licen[cs]e{_V} v? ?3(?: 0)?{_LATER}"),
    ("gpl-2.0", "gpl", r"gpl ?v? ?2(?: 0)?(?: only)?"),
    ("gpl-3.0", "gpl", r"gpl ?v? ?3(?: 0)?(?: only)?"),
    ("gpl-2.0-or-later", "gpl", r"gpl ?v? ?2(?: 0)? or later"),
    ("gpl-3.0-or-later", "gpl", r"gpl ?v? ?3(?: 0)? or later"),
    ("lgpl-2.1", "lesser", rf"gnu lesser general public licen[cs]e{_V} v? ?2 1"),
    ("lgpl-3.0", "lesser", rf"gnu lesser general public licen[cs]e{_V} v? ?3(?: 0)?"),
    ("lgpl-2.0", "library general", rf"gnu library general public licen[cs]e(?:{_V} v? ?2(?: 0)?)?"),
    ("lgpl", "lesser", r"gnu lesser general public licen[cs]e"),
    ("lgpl-2.1", "lgpl", r"lgpl ?v? ?2 1"),
    ("lgpl-3.0", "lgpl", r"lgpl ?v? ?3(?: 0)?"),
    ("agpl-3.0", "affero", rf"gnu affero general public licen[cs]e{_V} v? ?3(?: 0)?"),
    ("agpl", "affero", r"gnu affero general public licen[cs]e"),
    ("agpl-3.0", "agpl", r"agpl ?v? ?3(?: 0)?"),
    ("gfdl", "free documentation", rf"gnu free documentation licen[cs]e(?:{_V} v? ?1 [123])?"),
    ("apache-1.0", "apache", rf"apache(?: software)? licen[cs]e{_V} v? ?1 0"),
    ("apache-1.1", "apache", rf"apache(?: software)? licen[cs]e{_V} v? ?1 1"),
    ("apache-2.0", "apache", rf"apache(?: software)? licen[cs]e{_V} v? ?2(?: 0)?"),
    ("apache-2.0", "apache", r"apache 2(?: 0)? licen[cs]e"),
    ("mit", "mit", r"(?:the )?mit(?: x11| expat)? licen[cs]e"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)(?: simplified)? licen[cs]e"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|revised bsd)(?: new| revised)? licen[cs]e"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd) licen[cs]e"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[cs]e{_V} v? ?1 [01]"),
    ("mpl-2.0", "mozilla", rf"mozilla public licen[cs]e{_V} v? ?2(?: 0)?"),
    ("epl-1.0", "eclipse", rf"eclipse public licen[cs]e{_V} v? ?1(?: 0)?"),
    ("epl-2.0", "eclipse", rf"eclipse public licen[cs]e{_V} v? ?2(?: 0)?"),
    ("cddl-1.0", "common development", rf"common development and distribution licen[cs]e(?:{_V} v? ?1 [01])?"),
    ("eupl-1.2", "european union", rf"european union public licen[cs]e(?:{_V} v? ?1 [012])?"),
    ("artistic-2.0", "artistic", rf"artistic licen[cs]e{_V} v? ?2(?: 0)?"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: version)?(?: 1 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("python-2.0", "python software", r"python software foundation licen[cs]e"),
    ("ofl-1.1", "open font", rf"(?:sil )?open font licen[cs]e(?:{_V} v? ?1 [01])?"),
    ("odbl-1.0", "open database", r"open (?:data commons open )?database licen[cs]e(?: v?1 0)?"),
    ("pddl-1.0", "public domain dedication", r"public domain dedication and licen[cs]e"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-sa", "cc", r"cc by sa"),
    ("cc-by-nc", "cc", r"cc by nc"),
    ("cc-by-nd", "cc", r"cc by nd"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd"),
    *[(f"cc-by{k}-{v}", "cc", f"cc by{k.replace('-', ' ')} {v.replace('.', ' ')}") for k in ("", "-sa", "-nc", "-nd", "-nc-sa", "-nc-nd") for v in ("2.0", "3.0", "4.0")],
    *[
        (f"cc-by{k}{v and '-' + v}", "creative commons", f"creative commons attribution{words}(?: international| unported)?(?: licen[cs]e)?" + (f" {v.replace('.', ' ')}(?: international| unported)?(?: licen[cs]e)?" if v else ""))
        for k, words in (("", ""), ("-sa", " share ?alike"), ("-nc", " non ?commercial"), ("-nd", " no ?deriv(?:ative)?s?"), ("-nc-sa", " non ?commercial share ?alike"), ("-nc-nd", " non ?commercial no ?deriv(?:ative)?s?"))
        for v in ("", "2.0", "3.0", "4.0")
    ],
    ("gpl", "gpl", r"(?:the )?(?:gnu )?gpl"),
    ("lgpl", "lgpl", r"(?:the )?(?:gnu )?lgpl"),
    ("agpl", "agpl", r"(?:the )?(?:gnu )?agpl"),
    ("gpl-2.0-with-classpath-exception", "classpath", r"gpl(?: v? ?2(?: 0)?)? with (?:the )?classpath exception"),
    ("gpl-linking-exception", "special exception", r"as a special exception (?:the copyright holders|if you link|you may)"),
    ("gfdl-1.1", "free documentation", r"gnu free documentation licen[cs]e version 1 1"),
    ("gfdl-1.3", "free documentation", r"gnu free documentation licen[cs]e version 1 3"),
    ("sspl-1.0", "server side public", r"server side public licen[cs]e(?: version 1| v1)?"),
    ("bsl-1.1", "business source", r"business source licen[cs]e(?: 1 1| version 1 1)?"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: 2 0| version 2| v2)?"),
    ("commons-clause", "commons clause", r"commons clause(?: licen[cs]e condition)?"),
    ("polyform-noncommercial-1.0.0", "polyform", r"polyform non ?commercial licen[cs]e(?: 1 0 0)?"),
    ("polyform-shield-1.0.0", "polyform", r"polyform shield licen[cs]e(?: 1 0 0)?"),
    ("parity-7.0.0", "parity", r"parity public licen[cs]e(?: 7 0 0)?"),
    ("blueoak-1.0.0", "blue oak", r"blue oak model licen[cs]e(?: 1 0 0)?"),
    ("upl-1.0", "universal permissive", r"universal permissive licen[cs]e(?: v? ?1 0)?"),
    ("ncsa", "ncsa", r"(?:university of illinois ncsa|ncsa) open source licen[cs]e"),
    ("bsd-source-code", "source code attribution", r"bsd source code attribution"),
    ("0bsd", "0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]e)?"),
    ("0bsd", "zero clause", r"(?:bsd zero clause|zero clause bsd) licen[cs]e"),
    ("bsd-2-clause-patent", "plus patent", r"bsd(?: 2 clause)? plus patent licen[cs]e"),
    ("bsd-3-clause-clear", "clear bsd", r"(?:the )?clear bsd licen[cs]e"),
    ("bsd-protection", "bsd protection", r"bsd protection licen[cs]e"),
    ("afl-2.1", "academic free", r"academic free licen[cs]e (?:version |v ?)?2 1"),
    ("afl-3.0", "academic free", r"academic free licen[cs]e (?:version |v ?)?3 0"),
    ("afl", "academic free", r"academic free licen[cs]e"),
    ("osl-2.1", "open software", r"open software licen[cs]e (?:version |v ?)?2 1"),
    ("osl-3.0", "open software", r"open software licen[cs]e (?:version |v ?)?3 0"),
    ("osl", "open software", r"open software licen[cs]e"),
    ("apsl-2.0", "apple public", r"apple public source licen[cs]e(?: (?:version )?2 0)?"),
    ("cpl-1.0", "common public", r"common public licen[cs]e(?: (?:version |v ?)?1 0)?"),
    ("cpal-1.0", "common public attribution", r"common public attribution licen[cs]e(?: (?:version )?1 0)?"),
    ("ipl-1.0", "ibm public", r"ibm public licen[cs]e(?: (?:version )?1 0)?"),
    ("lpl-1.02", "lucent", r"lucent public licen[cs]e(?: version)?(?: 1 02)?"),
    ("spl-1.0", "sun public", r"sun public licen[cs]e(?: (?:version )?1 0)?"),
    ("sissl", "sun industry", r"sun industry standards source licen[cs]e"),
    ("mpl-1.0", "mozilla", r"mozilla public licen[cs]e (?:version |v ?)?1 0"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("mpl-2.0", "mpl", r"mpl ?v? ?2(?: 0)?"),
    ("mpl-1.1", "mpl", r"mpl ?v? ?1 1"),
    ("npl-1.1", "netscape", r"netscape public licen[cs]e(?: (?:version )?1 [01])?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("edl-1.0", "eclipse distribution", r"eclipse distribution licen[cs]e(?: (?:version |v ?)?1 0)?"),
    ("eupl-1.1", "european union", r"european union public licen[cs]e (?:version |v ?)?1 1"),
    ("eupl-1.2", "eupl", r"eupl(?: (?:version |v ?)?1 2)?"),
    ("cecill-2.1", "cecill", r"cecill(?: free software licen[cs]e(?: agreement)?)?(?: (?:version |v ?)?2 1)?"),
    ("cecill-b", "cecill b", r"cecill b(?: licen[cs]e)?"),
    ("cecill-c", "cecill c", r"cecill c(?: licen[cs]e)?"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e(?: ms pl)?"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e(?: ms rl)?"),
    ("qpl-1.0", "q public", r"q public licen[cs]e(?: version 1 0)?"),
    ("php-3.01", "php licen", r"php licen[cs]e (?:version |v ?)?3 01"),
    ("php-3.0", "php licen", r"php licen[cs]e (?:version |v ?)?3 0"),
    ("zpl-2.1", "zope", r"zope public licen[cs]e(?: (?:version )?2 1)?"),
    ("w3c", "w3c", r"w3c (?:software(?: and document)?(?: notice and)?|document) licen[cs]e"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("xfree86-1.1", "xfree86", r"xfree86 licen[cs]e(?: (?:version )?1 1)?"),
    ("curl", "curl", r"curl licen[cs]e"),
    ("libpng-2.0", "libpng", r"(?:png reference library|libpng) licen[cs]e(?: version 2)?"),
    ("libtiff", "libtiff", r"libtiff licen[cs]e"),
    ("ijg", "jpeg group", r"independent jpeg group s? ?(?:software|licen[cs]e)"),
    ("openssl", "openssl", r"open ?ssl licen[cs]e"),
    ("ssleay", "ssleay", r"(?:original )?ssleay licen[cs]e"),
    ("ruby", "ruby", r"ruby (?:s )?licen[cs]e"),
    ("perl-artistic-1.0", "perl", r"(?:same terms as perl(?: itself)?|perl artistic licen[cs]e)"),
    ("artistic-1.0", "artistic", r"artistic licen[cs]e (?:version |v ?)?1(?: 0)?"),
    ("clarified-artistic", "clarified artistic", r"clarified artistic licen[cs]e"),
    ("vim", "vim", r"vim licen[cs]e"),
    ("tcl", "tcl", r"tcl tk? ?licen[cs]e"),
    ("beerware", "beerware", r"(?:the )?beer ?ware licen[cs]e"),
    ("wtfpl-2.0", "what the", r"do what the \S+ you want to public licen[cs]e(?: version 2)?"),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e"),
    ("naist-2003", "naist", r"naist 2003 licen[cs]e"),
    ("unicode-dfs-2016", "unicode", r"unicode (?:licen[cs]e agreement|data files and software|licen[cs]e)"),
    ("icu", "icu", r"icu licen[cs]e"),
    ("hpnd", "historical permission", r"historical permission notice and disclaimer"),
    ("json", "used for good", r"(?:the )?software shall be used for good not evil"),
    ("jasper-2.0", "jasper", r"jasper licen[cs]e(?: version 2 0)?"),
    ("eiffel-2.0", "eiffel", r"eiffel forum licen[cs]e(?: version 2)?"),
    ("entessa", "entessa", r"entessa public licen[cs]e"),
    ("frameworx-1.0", "frameworx", r"frameworx open licen[cs]e(?: 1 0)?"),
    ("nokia-1.0a", "nokia", r"nokia open source licen[cs]e(?: version 1 0a)?"),
    ("rpl-1.5", "reciprocal public", r"reciprocal public licen[cs]e(?: (?:version )?1 5)?"),
    ("simpl-2.0", "simple public", r"simple public licen[cs]e(?: 2 0)?"),
    ("fair", "fair licen", r"(?:the )?fair licen[cs]e"),
    ("mirros", "miros", r"(?:the )?miros licen[cs]e"),
    ("mulanpsl-2.0", "mulan", r"mulan p(?:ermissive )?s(?:oftware)? ?l(?:icen[cs]e)?(?: version| v)? ?2"),
    ("motosoto", "motosoto", r"motosoto open source licen[cs]e"),
    ("ecos-2.0", "ecos", r"ecos licen[cs]e(?: version 2 0)?"),
    ("ecl-2.0", "educational community", r"educational community licen[cs]e(?: (?:version |v ?)?2 0)?"),
    ("nasa-1.3", "nasa", r"nasa open source agreement(?: version)?(?: 1 3)?"),
    ("lppl-1.3c", "latex", r"latex project public licen[cs]e(?: (?:version |v ?)?1 3c?)?"),
    ("ofl-1.0", "sil open", r"sil open font licen[cs]e (?:version |v ?)?1 0"),
    ("bitstream-vera", "bitstream", r"bitstream vera(?: fonts?)?(?: copyright| licen[cs]e)?"),
    ("arphic-1999", "arphic", r"arphic public licen[cs]e"),
    ("ubuntu-font-1.0", "ubuntu font", r"ubuntu font licen[cs]e(?: (?:version )?1 0)?"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[cs]e(?: v?1 0)?"),
    ("pddl-1.0", "pddl", r"pddl(?: 1 0)?"),
    ("cdla-permissive-2.0", "community data", r"community data licen[cs]e agreement permissive(?: (?:version )?2 0)?"),
    ("cdla-sharing-1.0", "community data", r"community data licen[cs]e agreement sharing(?: (?:version )?1 0)?"),
    ("ogl-uk-3.0", "open government", r"open government licen[cs]e(?: (?:version |v ?)?3 0)?"),
    ("etalab-2.0", "etalab", r"(?:licence ouverte|etalab(?: open licen[cs]e)?)(?: (?:version |v ?)?2 0)?"),
    ("dl-de-by-2.0", "datenlizenz", r"datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?"),
    ("cc-pdm-1.0", "public domain mark", r"(?:creative commons )?public domain mark(?: 1 0)?"),
    ("cc0-1.0", "no rights reserved", r"no rights reserved"),
    ("cc0-1.0", "creative commons", r"creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?"),
    ("cc-sampling-plus-1.0", "sampling", r"creative commons sampling plus(?: 1 0)?"),
    ("open-rail-m", "rail", r"(?:creative ?ml )?open ?rail m(?: licen[cs]e)?"),
    ("bigscience-rail-1.0", "bigscience", r"bigscience (?:bloom )?rail(?: 1 0)? licen[cs]e"),
    ("llama-community", "community license agreement", r"llama(?: \d)*(?: version \S+)? community license agreement"),
    ("gemma-terms", "gemma", r"gemma terms of use"),
    ("proprietary", "confidential", r"proprietary and confidential"),
    ("proprietary", "unauthorized", r"unauthori[sz]ed (?:copying|use|distribution|reproduction) of this (?:file|software|material|document)"),
    ("proprietary", "without the prior", r"may not be (?:reproduced|copied|distributed) (?:\S+ ){0,6}without the prior written (?:permission|consent)"),
    ("evaluation", "evaluation", r"for evaluation (?:purposes )?only"),
    ("noncommercial", "non commercial", r"(?:free )?for (?:personal and )?non commercial (?:use|purposes)(?: only)?"),
    ("academic-use", "academic", r"for (?:academic|research)(?: and (?:academic|research))? (?:use|purposes) only"),
    ("freeware", "freeware", r"(?:this (?:software|program) is )?freeware"),
    ("shareware", "shareware", r"(?:this (?:software|program) is )?shareware"),
    ("gpl", "general public", r"gnu general public licen[cs]e"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e"),
    ("cc-by", "cc", r"cc by"),
    ("public-domain", "public domain", r"(?:dedicated to|placed in|released into|in) the public domain"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("copyright-notice", "copyright", r"copyright (?:c )?(?:19|20)\d\d"),
]
#: What stands before a name in a notice: its words and the priority of the notice; the longest that fits counts.
NOTICES: list[tuple[bytes, int]] = [
    (rb"(?:(?:is |are )?(?:dual )?licen[cs]ed (?:to you )?under (?:the )?(?:terms of )?(?:the )?)", 2),
    (rb"(?:(?:released|distributed|made available|published|provided) under (?:the )?(?:terms of )?(?:the )?)", 2),
    (rb"(?:(?:subject to|under) the (?:terms (?:and conditions )?of the )?)", 1),
    (rb"(?:see (?:the )?)", 1),
    (rb"(?:spdx licen[cs]e identifier )", 3),
]
#: No notice has more bytes than this.
NOTICE_BYTES = 80
#: Sentences of license texts themselves: label, keyword, words.
TEXTS: list[tuple[str, str, str]] = [
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", "neither the name", r"neither the name of (?:\S+ ){1,12}nor the names of its contributors"),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", "free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("apache-2.0", "you may not use this file", r"you may not use this file except in compliance with the licen[cs]e"),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "as is without", r"this software is provided as is without any express or implied warranty"),
    ("warranty", "without warrant", r"without warrant(?:y|ies) of any kind"),
    ("mit", "above copyright notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e?)ment"),
    ("bsd", "provided by the", r"this software is provided by the (?:\S+ ){1,8}as is and any express(?:ed)? or implied warranties"),
    ("apache-2.0", "as is basis", r"distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "copy of the gnu", r"you should have received a copy of the gnu general public licen[cs]e along with this program"),
    ("lgpl", "copy of the gnu", r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("agpl-3.0", "copy of the gnu", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gpl", "verbatim copies", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document"),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented"),
    ("boost", "object code", r"machine executable object code generated by a source language processor"),
    ("isc", "appear in all copies", r"provided that the above copyright notice and this permission notice appear in all copies"),
    ("wtfpl", "just do what", r"you just do what the \S+ you want to"),
    ("unlicense", "anyone is free", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0-1.0", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("ofl-1.1", "font software", r"the font software may be modified altered or added to"),
    ("epl-2.0", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cddl-1.0", "this file are subject", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("mpl-1.1", "this file are subject", r"the contents of this file are subject to the mozilla public licen[cs]e"),
]


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: bytes
    pattern: re.Pattern[bytes]
    priority: int
    notice: bool


def _rules() -> list[Rule]:
    def made(kind: str, rows: list[tuple[str, str, str]], priority: int) -> list[Rule]:
        return [Rule(f"{label}-{kind}{i}", label, keyword.encode(), re.compile(b"(?<= )" + words.encode() + b"(?= )"), priority, kind == "name") for i, (label, keyword, words) in enumerate(rows)]

    return made("text", TEXTS, 4) + made("name", NAMES, 0)


RULES = _rules()
GATES = sorted({r.keyword for r in RULES} | {b"gnu", b"mit", b"apache", b"cc"})
#: A gate's words may be apart by any punctuation, so its first word gates the text, and all of it the joined words.
FIRSTS = {g: g.split(b" ")[0] for g in GATES}
#: How sure a detection is, by priority.
CONFIDENCE = (0.7, 0.8, 0.95, 0.99, 1.0)
_NOTICE = [(re.compile(b"(?<= )" + words + b"$"), priority) for words, priority in NOTICES]
_SPACED = bytes(b if ALNUM[b] else 32 for b in range(256))

Detection = tuple[int, int, str, str, int]


def standing(found: list[Detection]) -> list[Detection]:
    """Detections (start, end, label, rule, priority) that lie within no other of higher priority, nor within a longer one
    of their own; of equal intervals the first rule by name. In order of place."""
    kept: list[Detection] = []
    for level in sorted({d[4] for d in found}, reverse=True):
        starts, reach = [d[0] for d in kept], list(accumulate((d[1] for d in kept), max))
        far, fresh = -1, []
        for d in sorted((d for d in found if d[4] == level), key=lambda d: (d[0], -d[1], d[3])):
            above = bisect_right(starts, d[0])
            if far < d[1] and (not above or reach[above - 1] < d[1]):
                fresh.append(d)
            far = max(far, d[1])
        kept = sorted(kept + fresh)
    return kept


def _introduced(joined: bytes, at: int) -> tuple[int, int]:
    """Where the longest notice before a name at `at` begins, and its priority; (at, 0) where there is none."""
    best = (at, 0)
    for pattern, priority in _NOTICE:
        m = pattern.search(joined, max(0, at - NOTICE_BYTES), at)
        if m and (m.start(), -priority) < (best[0], -best[1]):
            best = (m.start(), priority)
    return best


def scan(folded: bytes) -> tuple[list[int], set[str], list[Detection]]:
    """(starts of base phrases, base labels, standing detections); places in words."""
    open_gates = [g for g, first in FIRSTS.items() if first in folded]
    if not open_gates:
        return [], set(), []
    joined = b" " + b" ".join(folded.translate(_SPACED).split()) + b" "
    open_gates = {g for g in open_gates if g in joined}
    if not open_gates:
        return [], set(), []
    base, labels = [], set()
    for phrase, label in BASE:
        text = f" {phrase} ".encode()
        at = joined.find(text)
        while at >= 0:
            base.append(at)
            labels.add(label)
            at = joined.find(text, at + 1)
    hits: list[tuple[int, int, Rule, int]] = []
    for rule in RULES:
        if rule.keyword in open_gates:
            for m in rule.pattern.finditer(joined):
                start, priority = _introduced(joined, m.start()) if rule.notice else (m.start(), rule.priority)
                hits.append((start, m.end(), rule, priority))
    # A place in bytes is a word by the number of spaces before it.
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    first = np.searchsorted(spaces, [h[0] for h in hits]) - 1
    last = np.searchsorted(spaces, [h[1] for h in hits])
    found = [(a, b, h[2].label, h[2].name, h[3]) for a, b, h in zip(first.tolist(), last.tolist(), hits, strict=True)]
    return sorted(np.searchsorted(spaces, base).tolist()), labels, standing(found)


SPAN = "array<struct<start:long,end:long,label:string,rule:string,priority:int>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, base_starts, base_labels, detections (start, end, label, rule, priority), score.

    base_starts are the places, in words from 0, where a base phrase's words stand consecutively. score is the
    confidence of the surest detection, 0.7 at least where a base phrase stands, else 0. A null or empty text has no
    word and no detection. Repeated rows get equal rows; ids, nulls among them, pass through; an empty table gives an
    empty result. A very long text is scanned whole, in time in proportion to its words and detections.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.string()), ("priority", pa.int32())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            texts = [fold(t) for t in b.column("text").to_pylist()]
            count, starts, base, spans, score = [], [], [], [], []
            for i in range(0, len(texts), 256):
                count.append(np.diff(Words(texts[i : i + 256], ALNUM, hashes=False).first))
            for t in texts:
                s, labels, found = scan(t)
                starts.append(s)
                base.append(sorted(labels))
                spans.append([dict(zip(("start", "end", "label", "rule", "priority"), d, strict=True)) for d in found])
                score.append(max([0.7] * bool(s) + [CONFIDENCE[d[4]] for d in found], default=0.0))
            arrays = [b.column("id"), pa.array(np.concatenate(count) if count else [], pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(base, pa.list_(pa.string())), pa.array(spans, span), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "base_starts", "base_labels", "detections", "score"])

    kind = own.schema["id"].dataType.simpleString()
    out = own.mapInArrow(run, f"id {kind}, n_words long, base_starts array<long>, base_labels array<string>, detections {SPAN}, score double")
    return out.withColumnRenamed("id", id_col)
