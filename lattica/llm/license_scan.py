"""Licence scan: ordered signature rules over whole texts, in DataFrame functions only.

Each licence gives several signature rules (an SPDX tag, a web address, a grant, a bare name, from one row of ``FAMILIES``), and the
sentences of licences and their notices are rules of their own (``SENTENCES``); a rule runs only on texts that hold its keyword. Rules have a priority: a detection inside the interval of one of a higher priority is dropped, and
so is one inside a longer (or the same, earlier ruled) interval of its own priority.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. Base phrases are counted over all places.
Null text counts as empty: no words, no labels, score 0. A null id is kept. Repeated rows each keep a row of their own, extra
columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NON_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD = f"[^{_NON_WORD}]"
#: The same characters, most frequent first and without giving back: several times faster to count.
WORDS = r"[a-z0-9A-Z\x{80}-\x{10FFFF}]++"
SEP = f"[{_NON_WORD}]"

BASE_PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))


def phrase_regex(phrase: str) -> str:
    """The words of ``phrase`` standing consecutively as whole words, in ASCII letters of either case."""
    return f"(?i)(?<!{WORD})" + f"{SEP}+".join(phrase.split()) + f"(?!{WORD})"


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    regex: str
    priority: int
    confidence: float
    also: str = ""  # a second word that its texts hold


#: label, name as a regex, keyword every text with the name holds (lower case), address regex or "". Alternatives without a
#: keyword in common have a row each.
FAMILIES = (
    ("mit", r"mit", "mit", r"opensource\.org/licenses/mit"),
    ("mit-0", r"mit no attribution", "attribution", r"opensource\.org/licenses/mit-0"),
    ("apache-1.0", r"apache (?:software )?license,? (?:version )?1\.0", "apache", r"apache\.org/licenses/license-1\.0"),
    ("apache-1.1", r"apache (?:software )?license,? (?:version )?1\.1", "apache", r"apache\.org/licenses/license-1\.1"),
    ("apache-2", r"apache (?:software )?license,? (?:version )?2(?:\.0)?", "apache", r"apache\.org/licenses/license-2\.0"),
    ("bsd-2-clause", r"(?:simplified bsd|bsd[- ]2[- ]clause|2[- ]clause bsd|freebsd)", "bsd", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|bsd[- ]3[- ]clause|3[- ]clause bsd)", "bsd", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", r"(?:original bsd|bsd[- ]4[- ]clause|4[- ]clause bsd)", "bsd", ""),
    ("0bsd", r"(?:zero[- ]clause bsd|bsd zero clause)", "bsd", r"opensource\.org/licenses/0bsd"),
    ("gpl-1.0", r"gnu general public license,? (?:version |v)?1(?:\.0)?", "general public", r"gnu\.org/licenses/gpl-1\.0"),
    ("gpl-2.0", r"gnu general public license,? (?:version |v)?2(?:\.0)?", "general public", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", r"gnu general public license,? (?:version |v)?3(?:\.0)?", "general public", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl", r"gnu general public license", "general public", r"gnu\.org/licenses/gpl"),
    ("lgpl-2.0", r"gnu (?:library|lesser) general public license,? (?:version |v)?2(?:\.0)?", "general public", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"),
    ("lgpl-2.1", r"gnu lesser general public license,? (?:version |v)?2\.1", "general public", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", r"gnu lesser general public license,? (?:version |v)?3(?:\.0)?", "general public", r"gnu\.org/licenses/lgpl-3\.0"),
    ("lgpl", r"gnu lesser general public license", "general public", r"gnu\.org/licenses/lgpl"),
    ("agpl-3.0", r"gnu affero general public license,? (?:version |v)?3(?:\.0)?", "affero", r"gnu\.org/licenses/agpl-3\.0"),
    ("agpl", r"gnu affero general public license", "affero", r"gnu\.org/licenses/agpl"),
    ("gfdl-1.2", r"gnu free documentation license,? (?:version )?1\.2", "documentation", r"gnu\.org/licenses/(?:old-licenses/)?fdl-1\.2"),
    ("gfdl-1.3", r"gnu free documentation license,? (?:version )?1\.3", "documentation", r"gnu\.org/licenses/fdl-1\.3"),
    ("mpl-1.0", r"mozilla public license,? (?:version |v\.? ?)?1\.0", "mozilla", r"mozilla\.org/mpl/1\.0"),
    ("mpl-1.1", r"mozilla public license,? (?:version |v\.? ?)?1\.1", "mozilla", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", r"mozilla public license,? (?:version |v\.? ?)?2\.0", "mozilla", r"mozilla\.org/mpl/2\.0"),
    ("epl-1.0", r"eclipse public license,? (?:version |v ?)?1\.0", "eclipse", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", r"eclipse public license,? (?:version |v ?)?2\.0", "eclipse", r"eclipse\.org/legal/epl-2\.0"),
    ("edl-1.0", r"eclipse distribution license", "eclipse", r"eclipse\.org/org/documents/edl-v10"),
    ("cddl-1.0", r"common development and distribution license(?:,? version 1\.0)?", "common development", r"opensource\.org/licenses/cddl-1\.0"),
    ("cddl-1.1", r"common development and distribution license,? version 1\.1", "common development", ""),
    ("cpl-1.0", r"common public license(?:,? version 1\.0)?", "common public", r"opensource\.org/licenses/cpl1\.0"),
    ("isc", r"isc", "isc", r"opensource\.org/licenses/isc"),
    ("zlib", r"zlib(?:/libpng)?", "zlib", r"opensource\.org/licenses/zlib"),
    ("unlicense", r"(?:the )?unlicense", "unlicense", r"unlicense\.org"),
    ("wtfpl", r"do what the f[a-z*]+ you want to public license", "public license", r"wtfpl\.net"),
    ("artistic-1.0", r"artistic license(?:,? (?:version )?1\.0)?", "artistic", r"opensource\.org/licenses/artistic-1\.0"),
    ("artistic-2.0", r"artistic license,? (?:version )?2\.0", "artistic", r"opensource\.org/licenses/artistic-2\.0"),
    ("bsl-1.0", r"boost software license(?:,? (?:version )?1\.0)?", "boost", r"boost\.org/license_1_0"),
    ("busl-1.1", r"business source license(?:,? (?:version )?1\.1)?", "business source", r"mariadb\.com/bsl11"),
    ("sspl-1.0", r"server side public license(?:,? (?:version |v)?1)?", "server side", r"mongodb\.com/licensing/server-side-public-license"),
    ("elastic-2.0", r"elastic license(?:,? (?:version )?2(?:\.0)?)?", "elastic", r"elastic\.co/licensing/elastic-license"),
    ("eupl-1.1", r"european union public licen[cs]e,? (?:version |v\.? ?)?1\.1", "european union", ""),
    ("eupl-1.2", r"european union public licen[cs]e,? (?:version |v\.? ?)?1\.2", "european union", r"eupl\.eu/1\.2"),
    ("ms-pl", r"microsoft public license", "microsoft", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", r"microsoft reciprocal license", "microsoft", r"opensource\.org/licenses/ms-rl"),
    ("apsl-2.0", r"apple public source license(?:,? (?:version )?2\.0)?", "apple public", r"opensource\.apple\.com/apsl"),
    ("ibm-pl", r"ibm public license", "ibm", r"opensource\.org/licenses/ibmpl"),
    ("qpl-1.0", r"q public license", "q public", r"opensource\.org/licenses/qpl-1\.0"),
    ("python-2.0", r"psf license", "psf", r"python\.org/psf/license"),
    ("python-2.0", r"python software foundation license", "python", ""),
    ("php-3.01", r"php license(?:,? version 3\.01)?", "php", r"php\.net/license/3_01"),
    ("ruby", r"ruby license", "ruby", r"ruby-lang\.org/en/about/license"),
    ("perl", r"same terms as perl itself", "perl", r"dev\.perl\.org/licenses"),
    ("postgresql", r"postgresql license", "postgresql", r"opensource\.org/licenses/postgresql"),
    ("openssl", r"openssl license", "openssl", r"openssl\.org/source/license"),
    ("curl", r"curl license", "curl", r"curl\.se/docs/copyright"),
    ("x11", r"x11 license", "x11", ""),
    ("ncsa", r"university of illinois/ncsa open source license", "ncsa", r"opensource\.org/licenses/ncsa"),
    ("upl-1.0", r"universal permissive license(?:,? (?:version )?1\.0)?", "universal permissive", r"opensource\.org/licenses/upl"),
    ("ofl-1.1", r"sil open font license(?:,? (?:version )?1\.1)?", "open font", r"scripts\.sil\.org/ofl"),
    ("odbl-1.0", r"open database license", "open database", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by-1.0", r"open data commons attribution license", "open data commons", r"opendatacommons\.org/licenses/by"),
    ("pddl-1.0", r"public domain dedication and license", "public domain", r"opendatacommons\.org/licenses/pddl"),
    ("cc0-1.0", r"cc0(?: 1\.0)?", "cc0", r"creativecommons\.org/publicdomain/zero"),
    ("cc0-1.0", r"creative commons zero", "creative", ""),
    ("cc-pdm-1.0", r"public domain mark(?: 1\.0)?", "public domain", r"creativecommons\.org/publicdomain/mark"),
    ("cc-by", r"cc[- ]by(?: [1-4]\.0)?", "cc", r"creativecommons\.org/licenses/by/"),
    ("cc-by", r"creative commons attribution(?: [1-4]\.0)?", "creative", ""),
    ("cc-by-sa", r"cc[- ]by[- ]sa(?: [1-4]\.0)?", "cc", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-sa", r"creative commons attribution[- ]share-?alike(?: [1-4]\.0)?", "creative", ""),
    ("cc-by-nd", r"cc[- ]by[- ]nd(?: [1-4]\.0)?", "cc", r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-nd", r"creative commons attribution[- ]no-?derivat(?:ive|e)s(?: [1-4]\.0)?", "creative", ""),
    ("cc-by-nc", r"cc[- ]by[- ]nc(?: [1-4]\.0)?", "cc", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nc", r"creative commons attribution[- ]non-?commercial(?: [1-4]\.0)?", "creative", ""),
    ("cc-by-nc-sa", r"cc[- ]by[- ]nc[- ]sa(?: [1-4]\.0)?", "cc", r"creativecommons\.org/licenses/by-nc-sa/"),
    ("cc-by-nc-sa", r"creative commons attribution[- ]non-?commercial[- ]share-?alike(?: [1-4]\.0)?", "creative", ""),
    ("cc-by-nc-nd", r"cc[- ]by[- ]nc[- ]nd(?: [1-4]\.0)?", "cc", r"creativecommons\.org/licenses/by-nc-nd/"),
    ("cc-by-nc-nd", r"creative commons attribution[- ]non-?commercial[- ]no-?derivat(?:ive|e)s(?: [1-4]\.0)?", "creative", ""),
    ("openrail", r"(?:creativeml )?open rail-?[ms]+", "rail", r"huggingface\.co/spaces/[a-z]+/license"),
    ("llama", r"llama [0-9.]+ community license", "llama", r"llama\.meta\.com/license"),
    ("proprietary", r"all rights reserved", "rights reserved", ""),
    ("confidential", r"(?:proprietary and confidential|confidential and proprietary)", "confidential", ""),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|in?to) the public domain", "public domain", ""),
    ("ogl-uk-3.0", r"open government licen[cs]e(?: v?(?:ersion )?3(?:\.0)?)?", "open government", r"nationalarchives\.gov\.uk/doc/open-government-licence"),
    ("cecill-2.1", r"cecill(?:[- ]2\.1)?", "cecill", r"cecill\.info/licences/licence_cecill_v2\.1"),
    ("cecill-b", r"cecill-b", "cecill-b", r"cecill\.info/licences/licence_cecill-b"),
    ("cecill-c", r"cecill-c", "cecill-c", r"cecill\.info/licences/licence_cecill-c"),
    ("osl-3.0", r"open software license(?:,? (?:version |v\.? ?)?3\.0)?", "open software", r"opensource\.org/licenses/osl-3\.0"),
    ("afl-3.0", r"academic free license(?:,? (?:version |v\.? ?)?3\.0)?", "academic free", r"opensource\.org/licenses/afl-3\.0"),
    ("vim", r"vim license", "vim", ""),
    ("tcl", r"tcl/tk license", "tcl", ""),
    ("json", r"shall be used for good,? not evil", "not evil", r"json\.org/license"),
    ("beerware", r"beer-?ware", "ware", ""),
    ("mulan-2.0", r"mulan p(?:ermissive )?s(?:oftware )?l(?:icense)?,? v(?:ersion )?2", "mulan", r"license\.coscl\.org\.cn/mulanpsl2"),
    ("etalab-2.0", r"licence ouverte(?:[ /]+etalab)?(?: v?2\.0)?", "ouverte", r"etalab\.gouv\.fr/licence-ouverte"),
    ("etalab-2.0", r"etalab(?:[ /]+etalab)?(?: v?2\.0)?", "etalab", ""),
)

#: priority, confidence of the forms; a tag and an address name a licence outright, a bare name may only mention it.
TAG, ADDRESS, GRANT, NAME = (40, 1.0), (30, 0.95), (20, 0.9), (10, 0.6)
#: A single short word needs "license" beside it before its bare name counts.
_BARE_TOO_SHORT = frozenset({"mit", "isc", "zlib", "vim", "cc-by"})
#: Names that can do without the word "license" though it stands in their regex.
_LICENSE_OPTIONAL = frozenset({"etalab-2.0", "mulan-2.0"})
#: Tags, as regexes, that aren't the label as it stands.
_TAGS = {"apache-2": r"apache-2(?:[.]0)?"}


#: label, a word that every text of the rule holds, a sentence of the licence or of its usual notice. A blank stands for any white space.
SENTENCES = (
    ("mit", "permission", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit", "merchantability", r"the software is provided [\"'\u201c]?as is[\"'\u201d]?, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    ("mit", "permission", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software"),
    ("isc", "permission", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "permission", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse", r"neither the name of (?:the )?\S+(?: \S+){0,9}? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2", "apache", r"you may obtain a copy of the license at https?://www\.apache\.org/licenses/license-2\.0"),
    ("apache-2", "distributed", r"unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "published", r"under the terms of the gnu general public license as published by the free software foundation; either version 2(?: of the license)?, or \(at your option\) any later version"),
    ("gpl-3.0", "published", r"under the terms of the gnu general public license as published by the free software foundation,? either version 3(?: of the license)?, or \(at your option\) any later version"),
    ("gpl", "received", r"you should have received a copy of the gnu general public license along with this program"),
    ("gpl-2.0", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it\. by contrast, the gnu general public license"),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("lgpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this library"),
    ("agpl", "affero", r"you can redistribute it and/or modify it under the terms of the gnu affero general public license"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public license along with this program"),
    ("gfdl", "documentation", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("epl-1.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0"),
    ("epl-2.0", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v\. )?2\.0"),
    ("cddl-1.0", "development", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", "accompanying", r"the accompanying program is provided under the terms of this common public license"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such, and must not be misrepresented"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "dedicate", r"the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("artistic-2.0", "package", r"this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed"),
    ("bsl-1.0", "boost", r"boost software license - version 1\.0 - august 17th, 2003"),
    ("bsl-1.0", "organization", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("busl-1.1", "production", r"the licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work"),
    ("sspl-1.0", "service", r"if you make the functionality of the program or a modified version available to third parties as a service, you must make the service source code available"),
    ("elastic-2.0", "managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("eupl-1.2", "eupl", r"licensed under the eupl(?:,| ) version 1\.2"),
    ("python-2.0", "psf", r"psf hereby grants licensee a nonexclusive, royalty-free, world-?wide license"),
    ("postgresql", "postgresql", r"postgresql is released under the postgresql license"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("x11", "consortium", r"except as contained in this notice, the name of the x consortium shall not be used in advertising"),
    ("ncsa", "illinois", r"neither the names of \S+(?: \S+){0,9}? university of illinois"),
    ("upl-1.0", "lrgrwrks", r"software and/or hardware listed in the lrgrwrks\.txt file"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license, version 1\.1"),
    ("odbl-1.0", "database", r"this \S+(?: \S+){0,9}? is made available under the open database license"),
    ("pddl-1.0", "domain", r"this \S+(?: \S+){0,9}? is made available under the public domain dedication and license"),
    ("cc0-1.0", "waived", r"to the extent possible under law, \S+(?: \S+){0,19}? has waived all copyright and related or neighbou?ring rights"),
    ("cc-by", "creative", r"this work is licensed under a creative commons attribution (?:[1-4]\.0 )?(?:international|unported) license"),
    ("cc-by-sa", "creative", r"this work is licensed under a creative commons attribution-sharealike (?:[1-4]\.0 )?(?:international|unported) license"),
    ("cc-by-nc", "creative", r"this work is licensed under a creative commons attribution-noncommercial (?:[1-4]\.0 )?(?:international|unported) license"),
    ("cc-by-nc-sa", "creative", r"this work is licensed under a creative commons attribution-noncommercial-sharealike (?:[1-4]\.0 )?(?:international|unported) license"),
    ("cc-by-nc-nd", "creative", r"this work is licensed under a creative commons attribution-noncommercial-noderivatives (?:[1-4]\.0 )?(?:international|unported) license"),
    ("openrail", "restrictions", r"use-based restrictions as referenced in paragraph 5"),
    ("llama", "llama", r"llama [0-9](?:\.[0-9])? is licensed under the llama"),
    ("ogl-uk-3.0", "information", r"contains public sector information licensed under the open government licen[cs]e v3\.0"),
    ("cecill-2.1", "cecill", r"this software is governed by the cecill license under french law"),
    ("beerware", "beer", r"if we meet some day, and you think this stuff is worth it, you can buy me a beer in return"),
    ("json", "evil", r"the software shall be used for good, not evil"),
    ("perl", "perl", r"you can redistribute it and/or modify it under the same terms as perl itself"),
    ("ruby", "ruby", r"you can redistribute it and/or modify it under either the terms of the (?:2-clause bsdl|gpl) \S+(?: \S+){0,9}? ruby"),
    ("proprietary", "proprietary", r"this software is (?:the )?(?:confidential and )?proprietary (?:information|property) of"),
    ("proprietary", "reproduced", r"no part of this (?:publication|document|work) may be reproduced,? \S+(?: \S+){0,19}? without the prior written (?:permission|consent)"),
    ("confidential", "confidential", r"this (?:document|e-?mail|message) (?:contains|may contain) confidential information"),
)

_GRANTED = r"(?:(?:re)?licen[sc]ed|released|distributed|available|published|made)\s+(?:\w+\s+){0,2}"


def _loose(name: str) -> str:
    """Let a blank of the rule stand for any run of white space."""
    return name.replace(" ", r"\s+")


def signatures() -> list[Signature]:
    """All rules. A keyword of several words is reduced to its longest, which stands unbroken wherever white space falls."""
    out, tagged = [], set()
    for label, name, words, address in FAMILIES:
        keyword = max(words.split(), key=len)
        if label not in tagged:
            tagged.add(label)
            tag = _TAGS.get(label, label.replace(".", "[.]"))
            out.append(Signature(label, "spdx", rf"spdx-license-identifier:\s*{tag}(?:-only|-or-later|\+)?(?![\w.-])", *TAG))
        if address:
            out.append(Signature(label, address.split("/")[0].replace("\\", "").lower(), rf"https?://(?:www\.)?{address}(?![a-z])", *ADDRESS))
        grant = rf"(?<!\w){_GRANTED}under\s+(?:the\s+(?:terms\s+of\s+the\s+)?)?{_loose(name)}(?!\w)(?:\s+licen[cs]e)?"
        out.append(Signature(label, keyword, grant, *GRANT, "under"))
        tail = r"\s+licen[cs]e(?!\w)" if label in _BARE_TOO_SHORT else r"(?!\w)"
        also = "licen" if "licen" in name + tail and label not in _LICENSE_OPTIONAL else ""
        out.append(Signature(label, keyword, rf"(?<!\w){_loose(name)}{tail}", *NAME, also))
    for label, word, sentence in SENTENCES:
        out.append(Signature(label, word, _loose(sentence), *GRANT))
    return out


#: Every signature's text holds one of these (lower case): plain searches, so that most texts meet no regex at all.
#: Single words only, as white space between words may be a line's end. "cc by" and grants have tests of their own.
GATE = (
    "licen", "spdx", "://", "cc0", "bsd", "creative", "reserved", "confidential", "public", "beerware", "beer-ware", "cecill", "ouverte", "etalab",
    "mulan", "rail", "evil", "perl", "granted", "permission", "redistribution", "attribution", "merchantability", "misrepresented", "advertising", "warranty",
    "endorse", "redistribute", "unencumbered", "dedicate", "managed", "waived", "proprietary", "reproduced", "beer", "openssl", "illinois",
    "functionality", "use-based", "lrgrwrks", "apache",
)


def _lowered(text: Column, test) -> Column:
    """``test`` of the lower-cased text, which is made once a row: a filter would repeat it for each of its uses."""
    return F.element_at(F.transform(F.array(F.lower(text)), test), 1)


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _gate(low: Column) -> Column:
    """Whether a lower-cased text can hold any signature's text at all."""
    return _any_of(low, GATE) | (F.contains(low, F.lit("cc")) & low.rlike(r"cc[-+\s]by")) | (F.contains(low, F.lit("under")) & low.rlike(rf"{_GRANTED}under\s"))


def _due(low: Column, rule: Column) -> Column:
    """Whether a lower-cased text holds the words without which the rule finds nothing."""
    return F.contains(low, rule["keyword"]) & F.contains(low, rule["also"])


def _ends(text: Column, regex: Column, found: Column) -> Column:
    """(start, end) of every match: the pieces between matches and the matches, laid end to end."""
    pieces = F.split(text, regex, -1)
    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("gap"), found.alias("hit"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("s"), end.alias("e")))).alias("spans"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["spans"])


def detections(docs: DataFrame, *, key: str, text_col: str = "text", rules: list[Signature] | None = None) -> DataFrame:
    """Surviving detections (key, label, start, end, priority, confidence) of all rules over whole texts; ``key`` must be unique."""
    rules = signatures() if rules is None else rules
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = [{"label": r.label, "keyword": r.keyword, "also": r.also, "regex": "(?i)" + r.regex, "priority": r.priority, "confidence": r.confidence, "ord": i} for i, r in enumerate(rules)]
    # One text that the optimizer turns into a constant, instead of a column for each fact of each rule.
    table = F.from_json(F.lit(json.dumps(facts)), "array<struct<label:string,keyword:string,also:string,regex:string,priority:int,confidence:double,ord:int>>")
    gated = docs.select(F.col(key), text.alias("_text")).where(_lowered(F.col("_text"), _gate))
    due = gated.select(key, "_text", F.explode(_lowered(F.col("_text"), lambda low: F.filter(table, lambda r: _due(low, r)))).alias("r"))
    hits = due.withColumn("_found", F.regexp_extract_all("_text", F.col("r.regex"), F.lit(0))).where(F.size("_found") > 0)
    spans = hits.select(key, "r.label", "r.priority", "r.confidence", "r.ord", F.explode(_ends(F.col("_text"), F.col("r.regex"), F.col("_found"))).alias("p"))
    flat = spans.select(key, "label", "priority", "confidence", "ord", F.col("p.s").alias("start"), F.col("p.e").alias("end"))
    before = Window.partitionBy(key).orderBy("start", F.desc("end"), F.desc("priority"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for level in sorted({r.priority for r in rules}):
        reach = F.max(F.when(F.col("priority") >= level, F.col("end"))).over(before)
        inside = inside | ((F.col("priority") == level) & (F.coalesce(reach, F.lit(-1)) >= F.col("end")))
    return flat.withColumn("_inside", inside).where(~F.col("_inside")).select(key, "label", "start", "end", "priority", "confidence")


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word count, base phrase places, base and all labels, and a score (the best detection's confidence)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = "(?i)" + "|".join(f"(?:{phrase_regex(p)[4:]})" for _, p in BASE_PHRASES)
    # Rows are told apart by id and text, so that repeated or missing ids don't share detections.
    rows = docs.select(F.col(id_col), text.alias("_text")).withColumn("_key", F.struct(F.col(id_col), F.xxhash64("_text"), F.length("_text")))
    # Only texts with the phrases' rarest words (in any letter case, so that nothing is missed) meet the phrase regex.
    has = lambda low, *words: functools.reduce(operator.and_, [F.contains(low, F.lit(w)) for w in words])
    due = _lowered(F.col("_text"), lambda low: has(low, "license") | has(low, "cc", "nc", "by"))
    found = rows.withColumn("n_base", F.when(due, F.regexp_count("_text", F.lit(base))).otherwise(0).cast("long"))
    words = lambda c: F.regexp_count(c, F.lit(WORDS)).cast("long")
    some = F.col("n_base") > 0
    head = F.when(some, F.regexp_extract("_text", f"(?is)^(.*?)(?:{base[4:]})", 1))
    last = F.when(some, F.regexp_extract("_text", f"(?is)^(.*)(?:{base[4:]})", 1))
    labels = F.array_compact(F.array(*[F.when(some & F.col("_text").rlike(phrase_regex(p)), F.lit(label)) for label, p in BASE_PHRASES]))
    counted = found.select(
        id_col, "_key", words(F.col("_text")).alias("n_words"), "n_base", words(head).alias("first_word"), words(last).alias("last_word"), labels.alias("_base")
    )
    per_key = detections(rows, key="_key", text_col="_text").groupBy(F.col("_key").alias("_of")).agg(
        F.collect_set("label").alias("_labels"), F.max("confidence").alias("_conf"), F.count("*").alias("n_detections")
    )
    joined = counted.join(per_key, F.col("_key").eqNullSafe(F.col("_of")), "left")
    every = F.array_sort(F.array_distinct(F.concat("_base", F.coalesce("_labels", F.array().cast("array<string>")))))
    score = F.greatest(F.when(some, F.lit(0.9)).otherwise(0.0), F.coalesce("_conf", F.lit(0.0)))
    return joined.select(
        id_col, "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), score.alias("score"), F.coalesce("n_detections", F.lit(0)).cast("long").alias("n_detections"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
