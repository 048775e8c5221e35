"""License scans: ordered signature rules with keyword gates and interval suppression.

A text becomes its words with one space between, so that rules see phrases however they are set.
Each rule is a regular expression with a keyword: only the rules whose keyword occurs are run. Where
detections overlap, a rule of higher priority suppresses what lies inside its interval; of equal
priority the longer one does.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts

#: Phrases of the base scan and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, keywords (one of them is in every match), names (regular expressions over words in lower case), identifiers (likewise).
NAMES = [
    ("apache-1.0", "apache", r"apache (?:software )?license (?:version )?1 0", r"apache 1 0"),
    ("apache-1.1", "apache", r"apache (?:software )?license (?:version )?1 1", r"apache 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?license (?:version )?2(?: 0)?", r"apache 2(?: 0)?"),
    ("mit", "mit expat", r"mit license|mit x11 license|expat license", r"mit"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd license|bsd 2 clause(?: license)?", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|revised|3 clause|three clause) bsd license|bsd 3 clause(?: license)?", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original|old|4 clause|four clause) bsd license|bsd 4 clause(?: license)?", r"bsd 4 clause"),
    ("gpl-1.0", "general gpl", r"gnu general public license (?:version |v )?1(?: 0)?|gpl ?v?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "general gpl", r"gnu general public license (?:version |v )?2(?: 0)?|gpl ?v?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general gpl", r"gnu general public license (?:version |v )?3(?: 0)?|gpl ?v?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("lgpl-2.0", "library", r"gnu library general public license(?: (?:version )?2(?: 0)?)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser lgpl", r"gnu lesser general public license (?:version |v )?2 1|lgpl ?v?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser lgpl", r"gnu lesser general public license (?:version |v )?3(?: 0)?|lgpl ?v?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("agpl-3.0", "affero agpl", r"gnu affero general public license(?: (?:version |v )?3(?: 0)?)?|agpl ?v?3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("gfdl", "documentation", r"gnu free documentation license(?: (?:version )?1 [123])?", r"gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v )?1 1", r"mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license (?:version |v )?2 0", r"mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public license (?:version |v )?1 0", r"epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public license (?:version |v )?2 0", r"epl 2 0"),
    ("cddl-1.0", "distribution", r"common development and distribution license(?: (?:version )?1 0)?", r"cddl 1 0"),
    ("cpl-1.0", "common", r"common public license(?: (?:version )?1 0)?", r"cpl 1 0"),
    ("cc0", "cc0 zero", r"creative commons zero|cc0 1 0(?: universal)?", r"cc0 1 0"),
    ("cc-by-2.0", "commons", r"creative commons attribution 2 0(?: generic)?", r"cc by 2 0"),
    ("cc-by-3.0", "commons", r"creative commons attribution 3 0(?: unported)?", r"cc by 3 0"),
    ("cc-by-4.0", "commons", r"creative commons attribution 4 0(?: international)?", r"cc by 4 0"),
    ("cc-by-sa-3.0", "commons", r"creative commons attribution share ?alike 3 0(?: unported)?", r"cc by sa 3 0"),
    ("cc-by-sa-4.0", "commons", r"creative commons attribution share ?alike 4 0(?: international)?", r"cc by sa 4 0"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial [234] 0", r"cc by nc [234] 0"),
    ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:s|atives) [234] 0", r"cc by nd [234] 0"),
    ("cc-by-nc-sa", "commons", r"creative commons attribution non ?commercial share ?alike [234] 0", r"cc by nc sa [234] 0"),
    ("cc-by-nc-nd", "commons", r"creative commons attribution non ?commercial no ?deriv(?:s|atives) [234] 0", r"cc by nc nd [234] 0"),
    ("artistic-1.0", "artistic", r"artistic license (?:version )?1(?: 0)?", r"artistic 1 0"),
    ("artistic-2.0", "artistic", r"artistic license (?:version )?2(?: 0)?", r"artistic 2 0"),
    ("boost-1.0", "boost", r"boost software license(?: (?:version )?1 0)?", r"bsl 1 0"),
    ("isc", "isc", r"isc license", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)? license", r"zlib"),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense"),
    ("wtfpl", "want", r"do what the f[^ ]+ you want to public license", r"wtfpl"),
    ("ofl-1.1", "font", r"sil open font license(?: (?:version )?1 1)?", r"ofl 1 1"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: (?:version |v )?1 2)?", r"eupl 1 2"),
    ("eupl-1.1", "european", r"european union public licen[cs]e (?:version |v )?1 1", r"eupl 1 1"),
    ("odbl", "data", r"open data ?base license(?: (?:version )?1 0)?", r"odbl 1 0"),
    ("odc-by", "attribution", r"open data commons attribution license", r"odc by 1 0"),
    ("pddl", "dedication", r"open data commons public domain dedication(?: and license)?", r"pddl 1 0"),
    ("python-2.0", "python", r"python software foundation license(?: (?:version )?2(?: 0)?)?", r"psf 2 0|python 2 0"),
    ("php-3.01", "php", r"php license (?:version )?3 0?1", r"php 3 0?1"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("openssl", "openssl", r"openssl license", r"openssl"),
    ("ms-pl", "microsoft", r"microsoft public license", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", r"ms rl"),
    ("ncsa", "illinois", r"university of illinois (?:ncsa )?open source license", r"ncsa"),
    ("vim", "vim", r"vim license", r"vim"),
    ("tcl", "tcl", r"tcl tk license", r"tcl"),
    ("w3c", "w3c", r"w3c software (?:notice and )?license", r"w3c"),
    ("unicode", "unicode", r"unicode (?:data files and software )?license(?: agreement)?", r"unicode dfs 201[56]|unicode 3 0"),
    ("llama-2", "llama", r"llama 2 community license(?: agreement)?", r"llama2"),
    ("llama-3", "llama", r"llama 3(?: [123])? community license(?: agreement)?", r"llama3(?: [123])?"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e", r"apache"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", r"bsd"),
    ("gpl", "gnu gpl", r"gnu gpl|gpl licen[cs]e", r"gpl"),
    ("lgpl", "lesser lgpl", r"gnu lesser general public licen[cs]e|gnu lgpl|lgpl licen[cs]e", r"lgpl"),
    ("agpl", "affero agpl", r"affero general public licen[cs]e|gnu agpl|agpl licen[cs]e", r"agpl"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", r"mpl"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", r"epl"),
    ("eupl", "european", r"european union public licen[cs]e", r"eupl"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[cs]e", r"artistic"),
    ("cc", "commons", r"creative commons licen[cs]e", r"creative commons"),
    ("cc-by", "commons", r"creative commons attribution(?: licen[cs]e)?(?! (?:share|non|no) ?)", r"cc by(?! (?:sa|nc|nd) )"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike(?: licen[cs]e)?", r"cc by sa"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial(?: licen[cs]e)?(?! (?:share|no) ?)", r"cc by nc(?! (?:sa|nd) )"),
    ("cc-by-nc-sa", "commons", r"creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?", r"cc by nc sa"),
    ("cc-by-nc-nd", "commons", r"creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: licen[cs]e)?", r"cc by nc nd"),
    ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:s|atives)(?: licen[cs]e)?", r"cc by nd"),
    ("ogl-uk", "government", r"open government licen[cs]e(?: v ?[123](?: 0)?)?", r"ogl(?: uk)? [123] 0"),
    ("etalab", "ouverte", r"licence ouverte(?: v ?[12](?: 0)?)?|licence ouverte open licence", r"etalab 2 0"),
    ("cecill", "cecill", r"(?:licence )?cecill(?: v ?[12](?: [01])?)?", r"cecill [12] [01]"),
    ("openrail", "rail", r"(?:creative ml|bigscience|bigcode) open ?rail m?(?: license)?", r"openrail m?"),
]
#: Identifiers that begin so and have more than one word mean a license wherever they stand.
CLEAR = ("cc ", "cc0 ", "gpl ", "lgpl ", "agpl ", "gfdl ", "mpl ", "epl ", "cddl ", "eupl ", "odbl ", "pddl ", "bsd ")
_UNDER = r"(?:is |are |be )?(?:dual )?(?:licensed|released|distributed|available|published|provided) (?:to you )?under (?:the |an? )?(?:terms (?:and conditions )?of )?(?:the )?"
#: How a name or an identifier stands in a notice: form, priority, confidence, with a name or an identifier.
FORMS = [
    (r"spdx license identifier {0}", 5, 1.0, "id"),
    (_UNDER + r"(?:{0})", 4, 0.95, "name"),
    (_UNDER + r"(?:{0})(?: licen[cs]e)?", 4, 0.9, "id"),
    (r"(?:subject to|governed by|covered by|in accordance with|in compliance with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{0})", 3, 0.9, "name"),
    (r"(?:see|read|copy of|text of) the (?:{0})", 2, 0.85, "name"),
    (r"(?:subject to|governed by|covered by|in accordance with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{0})(?: licen[cs]e)?", 3, 0.85, "id"),
    (r"licen[cs]e (?:is )?(?:{0})", 2, 0.8, "id"),
    (r"(?:{0})", 1, 0.7, "clear"),
    (r"(?:{0})", 1, 0.7, "name"),
]
#: Notices that name no license: label, keyword, expression, priority, confidence.
NOTICES = [
    ("cc-by", "by", r"cc by(?! (?:sa|nc|nd) )", 0, 0.6),
    ("gpl", "general", r"general public license", 0, 0.6),
    ("reserved", "reserved", r"all rights reserved", 0, 0.5),
    ("reserved", "droits", r"tous droits réservés", 0, 0.5),
    ("reserved", "rechte", r"alle rechte vorbehalten", 0, 0.5),
    ("reserved", "derechos", r"todos los derechos reservados", 0, 0.5),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d", 1, 0.4),
    ("copyright", "copyrighted", r"this (?:work|document|material) is copyrighted", 1, 0.4),
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in)?to the public domain|in the public domain", 1, 0.8),
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 4, 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 4, 1.0),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 4, 1.0),
    ("apache-2.0", "apache", r"(?:https? )?www apache org licenses license 2 0", 5, 1.0),
    ("gpl", "gnu", r"(?:https? )?www gnu org licenses(?: gpl)?", 3, 0.8),
    ("mpl-2.0", "mozilla", r"(?:https? )?(?:www )?mozilla org mpl 2 0", 5, 1.0),
    ("mit", "opensource", r"(?:https? )?(?:www )?opensource org licenses mit", 5, 1.0),
    ("cc-by", "creativecommons", r"(?:https? )?creativecommons org licenses by [1234] 0", 5, 1.0),
    ("cc-by-sa", "creativecommons", r"(?:https? )?creativecommons org licenses by sa [1234] 0", 5, 1.0),
    ("cc-by-nc", "creativecommons", r"(?:https? )?creativecommons org licenses by nc [1234] 0", 5, 1.0),
    ("cc0", "creativecommons", r"(?:https? )?creativecommons org publicdomain zero 1 0", 5, 1.0),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)", 2, 0.7),
    ("mit", "permission", r"the above copyright notice and this permission notice shall be included in all copies", 4, 1.0),
    ("mit", "without", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", 4, 1.0),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", 4, 1.0),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 4, 1.0),
    ("bsd-3-clause", "endorse", r"neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products", 4, 1.0),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 4, 1.0),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license", 3, 0.9),
    ("apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 3, 0.95),
    ("apache-2.0", "perpetual", r"perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", 3, 0.9),
    ("apache-1.1", "acknowledgment", r"this product includes software developed by the apache software foundation", 3, 0.8),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 4, 1.0),
    ("gpl-2.0", "version", r"either version 2 of the license or at your option any later version", 4, 0.95),
    ("gpl-3.0", "version", r"either version 3 of the license or at your option any later version", 4, 0.95),
    ("gpl", "received", r"you should have received a copy of the gnu general public license along with this program", 4, 1.0),
    ("gpl", "hope", r"distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability", 3, 0.8),
    ("gpl", "copyleft", r"gnu (?:general public license|gpl) is a free copyleft license", 4, 0.95),
    ("lgpl", "library", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", 4, 1.0),
    ("lgpl", "received", r"you should have received a copy of the gnu lesser general public license along with this", 4, 1.0),
    ("agpl-3.0", "affero", r"under the terms of the gnu affero general public license as published by the free software foundation", 4, 1.0),
    ("agpl-3.0", "affero", r"you should have received a copy of the gnu affero general public license along with this", 4, 1.0),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 4, 1.0),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts", 4, 0.95),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 5, 1.0),
    ("mpl", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 4, 0.95),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 5, 1.0),
    ("epl", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 4, 0.95),
    ("cddl-1.0", "distribution", r"the contents of this file are subject to the terms of the common development and distribution license", 4, 1.0),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 5, 1.0),
    ("unlicense", "compile", r"anyone is free to copy modify publish use compile sell or distribute this software", 4, 1.0),
    ("wtfpl", "want", r"you just do what the f[^ ]+ you want to", 4, 1.0),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 4, 1.0),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 4, 1.0),
    ("boost-1.0", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 5, 1.0),
    ("artistic", "package", r"the intent of this document is to state the conditions under which a package may be copied", 4, 1.0),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license", 5, 1.0),
    ("ofl-1.1", "font", r"the font software may not be sold by itself", 3, 0.8),
    ("cc0", "waived", r"to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright and related or neighbou?ring rights", 5, 1.0),
    ("cc0", "reserved", r"no rights reserved", 1, 0.6),
    ("cc-by-nd", "creativecommons", r"(?:https? )?creativecommons org licenses by nd [1234] 0", 5, 1.0),
    ("cc-by-nc-sa", "creativecommons", r"(?:https? )?creativecommons org licenses by nc sa [1234] 0", 5, 1.0),
    ("cc-by-nc-nd", "creativecommons", r"(?:https? )?creativecommons org licenses by nc nd [1234] 0", 5, 1.0),
    ("public-domain", "creativecommons", r"(?:https? )?creativecommons org publicdomain mark 1 0", 5, 1.0),
    ("lgpl", "gnu", r"(?:https? )?www gnu org licenses lgpl", 5, 0.95),
    ("agpl-3.0", "gnu", r"(?:https? )?www gnu org licenses agpl", 5, 0.95),
    ("gfdl", "gnu", r"(?:https? )?www gnu org licenses fdl", 5, 0.95),
    ("bsd-3-clause", "opensource", r"(?:https? )?(?:www )?opensource org licenses bsd 3 clause", 5, 1.0),
    ("bsd-2-clause", "opensource", r"(?:https? )?(?:www )?opensource org licenses bsd 2 clause", 5, 1.0),
    ("apache-2.0", "opensource", r"(?:https? )?(?:www )?opensource org licenses apache 2 0", 5, 1.0),
    ("epl-2.0", "eclipse", r"(?:https? )?www eclipse org legal epl (?:v20|2 0)", 5, 1.0),
    ("eupl", "joinup", r"(?:https? )?joinup ec europa eu (?:collection )?(?:software page )?eupl", 4, 0.9),
    ("ogl-uk", "nationalarchives", r"(?:https? )?www nationalarchives gov uk doc open government licence", 5, 0.95),
    ("crown", "crown", r"crown copyright(?: (?:19|20)\d\d)?", 1, 0.6),
    ("us-government", "government", r"(?:is a )?work of the (?:u s|united states) (?:federal )?government", 2, 0.7),
    ("non-commercial", "commercial", r"for non ?commercial (?:use|purposes) only", 2, 0.7),
    ("non-commercial", "personal", r"for (?:your )?personal(?: and)? (?:non ?commercial )?use only", 2, 0.6),
    ("non-commercial", "educational", r"for educational (?:use|purposes) only", 1, 0.5),
    ("non-commercial", "research", r"for (?:academic|research) (?:use|purposes) only", 2, 0.6),
    ("proprietary", "without", r"(?:may not|must not|cannot) be (?:copied |reproduced |redistributed |published |broadcast |rewritten |or |and ){1,9}(?:in any form )?without (?:the )?(?:express |prior )?(?:written )?(?:permission|consent)", 3, 0.8),
    ("proprietary", "unauthori", r"unauthori[sz]ed (?:copying|use|reproduction|distribution|duplication) (?:of this (?:file|document|material|work) )?(?:via any medium )?is (?:strictly )?prohibited", 3, 0.85),
    ("proprietary", "redistribution", r"not (?:intended )?for (?:public )?redistribution", 2, 0.6),
    ("proprietary", "trade", r"contains (?:proprietary|confidential) (?:information|trade secrets)", 2, 0.6),
    ("proprietary", "end", r"end user licen[cs]e agreement", 2, 0.7),
    ("proprietary", "subscribe", r"licensed to subscribers only", 2, 0.6),
    ("permission", "permission", r"(?:used|reprinted|reproduced) (?:here )?(?:with|by) (?:kind )?permission", 1, 0.5),
    ("permission", "verbatim", r"permission is granted to make and distribute verbatim copies", 3, 0.8),
    ("permission", "everyone", r"everyone is permitted to copy and distribute verbatim (?:or modified )?copies", 3, 0.8),
    ("permission", "freely", r"may be freely (?:copied|reproduced|distributed|used)", 1, 0.5),
    ("reserved", "réservés", r"droits réservés", 0, 0.4),
    ("reserved", "reserviert", r"alle rechte reserviert", 0, 0.5),
    ("proprietary", "interdite", r"reproduction (?:même partielle )?(?:strictement )?interdite", 2, 0.7),
    ("proprietary", "vervielfältigung", r"vervielfältigung (?:[^ ]+ ){0,6}(?:verboten|nicht gestattet|untersagt)", 2, 0.7),
    ("proprietary", "prohibida", r"prohibida (?:su|la) (?:reproducción|copia|distribución)(?: total o parcial)?", 2, 0.7),
    ("public-domain", "domaine", r"(?:dans le )?domaine public", 1, 0.6),
    ("public-domain", "gemeinfrei", r"gemeinfrei(?:es|e)?", 1, 0.6),
    ("public-domain", "dominio", r"(?:en el |de )?dominio público", 1, 0.6),
    ("cc", "bajo", r"bajo (?:una )?licencia creative commons", 3, 0.9),
    ("cc", "sous", r"sous (?:une )?licence creative commons", 3, 0.9),
    ("cc", "unter", r"unter (?:einer )?creative commons lizenz", 3, 0.9),
    ("copyright", "urheberrecht", r"urheberrechtlich geschützt", 1, 0.5),
    ("copyright", "derechos", r"derechos de autor", 0, 0.3),
    ("copyright", "auteur", r"droits d auteur", 0, 0.3),
    ("no-warranty", "liable", r"in no event shall the (?:authors?|copyright holders?|contributors?)(?: or (?:authors?|copyright holders?|contributors?))* be liable", 2, 0.6),
    ("no-warranty", "merchantability", r"including but not limited to the (?:implied )?warranties of merchantability", 1, 0.5),
    ("no-warranty", "express", r"without any express or implied warranty", 1, 0.5),
    ("no-warranty", "warranty", r"without warranty of any kind|as is without (?:any )?warranty", 0, 0.3),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    priority: int
    confidence: float


@functools.lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, those of high priority first."""
    made = []
    for label, keys, name, ident in NAMES:
        first = [f" {w} " for w in re.findall(r"(?:^|\|)([a-z0-9]+)", re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)", "", ident))]  # whole words, as identifiers are short
        for form, priority, sure, kind in FORMS:
            if kind != "clear" or ident.startswith(CLEAR):
                made.append((label, keys.split() if kind == "name" else first, form.format(f"(?:{name if kind == 'name' else ident})"), priority, sure))
    made += [(label, keys.split(), pattern, priority, sure) for label, keys, pattern, priority, sure in NOTICES]
    full = [Rule(label, tuple(k.encode() for k in keys), re.compile(f"(?<= )(?:{p})(?= )".encode()), priority, sure) for label, keys, p, priority, sure in made]
    return tuple(sorted(full, key=lambda r: (-r.priority, r.label)))


#: A-Z to lower case, and everything that no word holds to a space; bytes from 0x80 on stay.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_BASE = [(re.compile(f"(?= {phrase} )".encode()), label) for phrase, label in BASE.items()]


def folded(text: str) -> tuple[int, bytes]:
    """How many words a text has, and the words between single spaces, with one at each end."""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    return len(words), b" " + b" ".join(words) + b" "


def uncovered(intervals: list[tuple[int, int]]) -> list[bool]:
    """Which intervals lie in none of the uncovered ones before them.

    Only the widest intervals so far are kept, so starts and ends both ascend and one look-up decides.
    """
    starts: list[int] = []
    ends: list[int] = []
    out = []
    for a, b in intervals:
        k = bisect_right(starts, a)
        out.append(not (k and ends[k - 1] >= b))
        if out[-1]:
            first, last = bisect_left(starts, a), bisect_right(ends, b)
            starts[first:last], ends[first:last] = [a], [b]
    return out


def detections(line: bytes, every: tuple[Rule, ...]) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of what stands after suppression, in order of the text."""
    have: dict[bytes, bool] = {}
    found = []
    for rule in every:
        for key in rule.keywords:
            if key not in have:
                have[key] = key in line
            if have[key]:
                found += [(m.start(), m.end(), rule) for m in rule.pattern.finditer(line)]
                break
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label))
    free = uncovered([d[:2] for d in found])
    return sorted((d for d, ok in zip(found, free, strict=True) if ok), key=lambda d: d[:2])


def scan_text(text: str) -> dict:
    """What scan_licenses returns of one text."""
    n, line = folded(text)
    places = [(m.start(), label) for pattern, label in _BASE for m in pattern.finditer(line)]
    found = detections(line, rules())
    base = {label for _, label in places}
    edges = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.searchsorted(edges, [p for p, _ in places]).tolist()
    miss = 1.0
    for _, _, rule in found:
        miss *= 1 - rule.confidence
    return {
        "n_words": n,
        "n_base": len(places),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | {rule.label for _, _, rule in found})),
        "score": 1 - miss,
        "spans": [{"label": rule.label, "first": int(x) - 1, "last": int(y) - 1, "confidence": rule.confidence} for (_, _, rule), x, y in zip(found, np.searchsorted(edges, [d[0] for d in found]), np.searchsorted(edges, [d[1] for d in found]), strict=True)],
    }


MADE = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first: long, last: long, confidence: double>>"
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("confidence", pa.float64())])
COLUMNS = dict.fromkeys(("n_words", "n_base", "first_word", "last_word"), pa.int64()) | dict.fromkeys(("base_labels", "labels"), pa.string()) | {"score": pa.float64(), "spans": pa.list_(_SPAN)}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, word and base counts, labels, score, detected spans.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case.
    n_base counts all places of the base phrases, first_word and last_word are their smallest and
    largest start (null without any). labels adds those of the rules' detections; score is the chance
    that at least one detection is right. spans are word ranges, ends included. Null texts are empty;
    null and repeated ids keep their rows; an empty table gives an empty result; other columns are
    not read. Whole texts are scanned.
    """

    def scan(texts):
        made = [scan_text(t) for t in texts]
        return [pa.array([m[name] for m in made], kind) for name, kind in COLUMNS.items()]

    return map_texts(docs, [F.col(id_col).cast("long").alias(id_col)], F.col(text_col), MADE, scan)
