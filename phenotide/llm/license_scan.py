"""License scans: ordered signature rules over the words of a text.

A text is brought to its lower-case words, joined by single spaces. Each rule is a regular expression
over that string, in one of a few tiers, and names words without which it cannot match: one of each group of
alternatives. It is tried only if the text has these words. A detection that lies within one of a higher tier, or within a longer
one of its own tier, is suppressed. Labels and score come from the detections that are left.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenotide.llm.common import slices, text_of

# Phrases that always count, wherever their words stand consecutively, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Tiers, strongest first, with the confidence of a detection.
IDENTIFIER, NOTICE, TITLE, ADDRESS, NAME, HINT = range(6)
CONFIDENCE = (1.0, 0.95, 0.9, 0.85, 0.7, 0.4)


class Rule(NamedTuple):
    tier: int
    label: str
    pattern: str
    #: Groups of words: any match contains a word of each group. The first group finds the rule.
    words: tuple[frozenset[str], ...]


def groups_of(words: str) -> tuple[frozenset[str], ...]:
    """Groups between blanks, alternatives between slashes."""
    return tuple(frozenset(group.split("/")) for group in words.split())


# Licenses: label | identifiers, as words | title, as a pattern | groups of words of the title, the rarest first.
LICENSES = """
afl | afl 1 1, afl 1 2, afl 2 0, afl 2 1, afl 3 0 | academic free license | academic free
agpl | agpl 1 0, agpl 3 0, agpl 3 0 only, agpl 3 0 or later | (?:gnu )?affero general public licen[cs]e | affero general public
aladdin | aladdin | aladdin free public license | aladdin public
apache | apache 1 0, apache 1 1, apache 2 0 | apache(?: software)? licen[cs]e(?: version [12](?: [01])?)? | apache
apsl | apsl 1 0, apsl 1 1, apsl 1 2, apsl 2 0 | apple public source license | apple public source
artistic | artistic 1 0, artistic 1 0 perl, artistic 2 0, clartistic | (?:clarified )?artistic license | artistic license
beerware | beerware | (?:the )?beer ?ware license | license
blueoak | blueoak 1 0 0 | blue oak model license | blue oak model
bsd-0-clause | 0bsd | (?:zero|0) clause bsd(?: license)? | clause bsd
bsd-2-clause | bsd 2 clause, bsd 2 clause patent, bsd 2 clause views | (?:freebsd license|simplified bsd license|bsd 2 clause license) | license
bsd-3-clause | bsd 3 clause, bsd 3 clause clear, bsd 3 clause lbnl | (?:new|modified|revised) bsd license | bsd license
bsd-4-clause | bsd 4 clause, bsd 4 clause uc | (?:original|old) bsd license | bsd license
bsl | bsl 1 0 | boost software license | boost software
busl | busl 1 1 | business source license | business source
bzip2 | bzip2 1 0 6 | bzip2 license | bzip2
catosl | catosl 1 1 | computer associates trusted open source license | computer trusted
cc0 | cc0 1 0 | (?:cc0|creative commons zero)(?: universal)?(?: public domain dedication)? | cc0/commons
cc-pddc | cc pddc | creative commons public domain dedication | creative commons domain
cddl | cddl 1 0, cddl 1 1 | common development and distribution license | common development distribution
cecill | cecill 1 0, cecill 2 0, cecill 2 1, cecill b, cecill c | cecill(?: [bc])?(?: free software)? licen[cs]e | cecill
cpal | cpal 1 0 | common public attribution license | common public attribution
cpl | cpl 1 0 | common public license | common public
curl | curl | curl license | curl
ecl | ecl 1 0, ecl 2 0 | educational community license | educational community
efl | efl 1 0, efl 2 0 | eiffel forum license | eiffel forum
elastic | elastic 2 0 | elastic license | elastic
entessa | entessa | entessa public license | entessa
epl | epl 1 0, epl 2 0 | eclipse public license | eclipse public
eudatagrid | eudatagrid | eu datagrid software license | datagrid
eupl | eupl 1 0, eupl 1 1, eupl 1 2 | european union public licen[cs]e | european union public
fair | fair | fair license | fair license
fdl | gfdl 1 1, gfdl 1 2, gfdl 1 3, gfdl 1 3 or later | gnu free documentation license | gnu free documentation
ftl | ftl | freetype (?:project )?license | freetype
gpl | gpl 1 0, gpl 2 0, gpl 2 0 only, gpl 2 0 or later, gpl 3 0, gpl 3 0 only, gpl 3 0 or later | (?:gnu )?general public licen[cs]e(?: version [123](?: 0)?)? | general public
hpnd | hpnd | historical permission notice and disclaimer | historical permission notice
icu | icu | icu license | icu
imagemagick | imagemagick | imagemagick license | imagemagick
ipa | ipa | ipa font license | ipa font
ipl | ipl 1 0 | ibm public license | ibm public
isc | isc | isc license | isc license
jasper | jasper 2 0 | jasper license | jasper
json | json | json license | json
lgpl | lgpl 2 0, lgpl 2 1, lgpl 2 1 only, lgpl 2 1 or later, lgpl 3 0, lgpl 3 0 only, lgpl 3 0 or later | gnu (?:lesser|library) general public licen[cs]e(?: version [23](?: [01])?)? | gnu general public
libpng | libpng, libpng 2 0 | (?:png reference library|libpng) license | license
lppl | lppl 1 0, lppl 1 1, lppl 1 2, lppl 1 3a, lppl 1 3c | latex project public license | latex project public
miros | miros | miros licen[cs]e | miros
mit | mit, mit 0, mit modern variant | (?:mit|expat) licen[cs]e | mit/expat
motosoto | motosoto | motosoto open source license | motosoto
mpl | mpl 1 0, mpl 1 1, mpl 2 0, mpl 2 0 no copyleft exception | mozilla public licen[cs]e(?: version [12](?: [01])?)? | mozilla public
ms-pl | ms pl | microsoft public license | microsoft public
ms-rl | ms rl | microsoft reciprocal license | microsoft reciprocal
mulan | mulanpsl 1 0, mulanpsl 2 0 | mulan permissive software license | mulan permissive
multics | multics | multics license | multics
nasa | nasa 1 3 | nasa open source agreement | nasa open source
naumen | naumen | naumen public license | naumen
ncsa | ncsa | (?:university of illinois )?ncsa open source license | ncsa open source
netcdf | netcdf | netcdf license | netcdf
ngpl | ngpl | nethack general public license | nethack
nokia | nokia | nokia open source license | nokia
npl | npl 1 0, npl 1 1 | netscape public license | netscape public
odbl | odbl 1 0 | open database license | open database
odc-by | odc by 1 0 | open data commons attribution license | open data commons attribution
ofl | ofl 1 0, ofl 1 1, ofl 1 1 rfn | sil open font license | sil open font
ogl | ogl uk 1 0, ogl uk 2 0, ogl uk 3 0 | open government licen[cs]e | open government
oldap | oldap 2 0, oldap 2 8 | openldap public license | openldap
openssl | openssl | openssl license | openssl
osl | osl 1 0, osl 1 1, osl 2 0, osl 2 1, osl 3 0 | open software license | open software
parity | parity 6 0 0, parity 7 0 0 | parity public license | parity
pddl | pddl 1 0 | open data commons public domain dedication(?: and license)? | open data commons dedication
php | php 3 0, php 3 01 | php license | php license
polyform | polyform noncommercial 1 0 0, polyform small business 1 0 0 | polyform (?:noncommercial|perimeter|shield|strict|internal use) license | polyform
postgresql | postgresql | postgresql licen[cs]e | postgresql
psf | psf 2 0, python 2 0 | python(?: software foundation)? license | python license
qpl | qpl 1 0 | q public license | q public
rpl | rpl 1 1, rpl 1 5 | reciprocal public license | reciprocal public
ruby | ruby | ruby license | ruby license
simpl | simpl 2 0 | simple public license | simple public
sissl | sissl, sissl 1 2 | sun industry standards source license | sun industry standards
sleepycat | sleepycat | sleepycat license | sleepycat
spl | spl 1 0 | sun public license | sun public
sspl | sspl 1 0 | server side public license | server side public
ucl | ucl 1 0 | upstream compatibility license | upstream compatibility
unicode | unicode dfs 2015, unicode dfs 2016, unicode tou, unicode 3 0 | unicode license(?: agreement)? | unicode license
unlicense | unlicense | (?:the )?unlicense | unlicense
upl | upl 1 0 | universal permissive license | universal permissive
vim | vim | vim license | vim
vsl | vsl 1 0 | vovida software license | vovida
w3c | w3c, w3c 19980720, w3c 20150513 | w3c software(?: notice and)?(?: document)? license | w3c software
watcom | watcom 1 0 | sybase open watcom public license | watcom
wtfpl | wtfpl | do what the fuck you want to public license | fuck public
x11 | x11 | x11 license | x11
xfree86 | xfree86 1 1 | xfree86 license | xfree86
xnet | xnet | x net license | x net license
zlib | zlib, zlib acknowledgement | zlib(?: libpng)? license | zlib
zpl | zpl 1 1, zpl 2 0, zpl 2 1 | zope public license | zope public
"""

# Sentences of license texts and notices: label | pattern | words of any match.
NOTICES = """
agpl | under the terms of the gnu affero general public licen[cs]e | gnu affero terms
apache | licensed under the apache license version 2 0 | licensed apache version
apache | you may not use this file except in compliance with the license | compliance license except
artistic | the intent of this document is to state the conditions under which a package may be copied | intent package copied
beerware | you can do whatever you want with this stuff if we meet some day | whatever stuff meet
bsd | redistribution and use in source and binary forms with or without modification are permitted | redistribution binary modification permitted
bsd | redistributions of source code must retain the above copyright notice | redistributions retain copyright
bsd | redistributions in binary form must reproduce the above copyright notice | redistributions reproduce copyright
bsd-3-clause | neither the names? of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products | neither contributors endorse promote
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment | advertising materials mentioning
bsl | permission is hereby granted free of charge to any person or organization obtaining a copy | permission organization obtaining
cc-by | (?:licensed under a )?creative commons attribution(?: [1234] [05])?(?: international| generic| unported)? licen[cs]e | creative commons attribution
cc0 | to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright | extent waived copyright
eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license | accompanying materials eclipse
fdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license | permission document gnu documentation
gpl | free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e | redistribute modify gnu
gpl | (?:either )?version [23](?: 0)? of the license or (?:at your option )?any later version | version license later
gpl | you should have received a copy of the gnu general public license | received gnu
isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted | permission distribute fee granted
lgpl | redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e | redistribute modify gnu
mit | permission is hereby granted free of charge to any person obtaining a copy | permission granted obtaining
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software | permission substantial portions
mpl | this source code form is subject to the terms of the mozilla public license | subject mozilla
ofl | this font software is licensed under the sil open font license | font sil
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee | permission documentation fee
public-domain | this is free and unencumbered software released into the public domain | unencumbered released domain
public-domain | (?:has been |is )?(?:placed|released|dedicated) (?:in|into|to) the public domain | public domain
public-domain | no rights reserved | rights reserved
public-domain | this work is in the public domain | work public domain
proprietary | all rights reserved | rights reserved
proprietary | strictly confidential and proprietary | confidential proprietary
proprietary | (?:reproduction|redistribution|copying) (?:[^ ]+ ){0,6}(?:is )?(?:strictly )?(?:prohibited|forbidden) | prohibited/forbidden reproduction/redistribution/copying
proprietary | may not be (?:copied|reproduced|redistributed|distributed) without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent) | may without
proprietary | for (?:personal|internal|evaluation) use only | use only
unlicense | anyone is free to copy modify publish use compile sell or distribute this software | anyone compile sell distribute
warranty | (?:the|this) software is provided as is without (?:any express or implied )?warrant(?:y|ies) | software provided
warranty | without even the implied warranty of merchantability | implied warranty merchantability
warranty | in no event (?:shall|will) (?:[^ ]+ ){1,14}be (?:held )?liable | event liable
wtfpl | you just do what the fuck you want to | fuck
zlib | altered source versions must be plainly marked as such | altered plainly marked
zlib | the origin of this software must not be misrepresented | origin misrepresented
"""

# Addresses, as words: label | pattern | words.
ADDRESSES = """
agpl | gnu org licenses agpl(?: 3 0)?(?: html| txt| en html)? | gnu org agpl
apache | apache org licenses license [12] [01](?: txt| html)? | apache org
artistic | (?:perlfoundation org|opensource org licenses) artistic license(?: [12] 0)? | artistic license
bsd | opensource org licenses? bsd(?: license|  ?[234] clause)? | opensource org bsd
bsl | boost org license 1 0(?: txt)? | boost org
cc0 | creativecommons org publicdomain zero(?: 1 0)? | creativecommons zero
cddl | opensource org licenses? cddl(?: 1 0)? | opensource cddl
epl | eclipse org (?:legal|org documents) epl(?: v(?:10|20|1 0|2 0))?(?: html)? | eclipse org epl
eupl | ec europa eu idabc eupl | europa eupl
fdl | gnu org licenses fdl(?: 1 [123])?(?: html| txt)? | gnu org fdl
gpl | gnu org licenses(?: old licenses)? gpl(?: [123] 0)?(?: html| txt| en html)? | gnu org gpl
isc | opensource org licenses? isc(?: license)? | opensource isc
lgpl | gnu org licenses(?: old licenses)? lgpl(?: [23] [01])?(?: html| txt| en html)? | gnu org lgpl
mit | opensource org licenses? mit(?: license)?(?: php| html)? | opensource mit
mpl | mozilla org(?: en us)? mpl(?: [12] [01])? | mozilla org mpl
ofl | (?:scripts sil org|openfontlicense org) ofl | ofl
unlicense | unlicense org | unlicense org
wtfpl | wtfpl net | wtfpl net
zlib | zlib net zlib license(?: html)? | zlib net
"""

GRANTED = "(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?"
# Parts of the Creative Commons names: attribution comes first, the others in this order.
COMMONS = {"nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Short names that people write: label | pattern | words.
NAMES = """
agpl | agpl(?: v?[13](?: 0)?)? | agpl
agpl | agplv[13](?: 0)? | agplv1/agplv3
apache | (?:apache|asl) v?2(?: 0)? | apache/asl
apache | (?:apache|asl)v?2(?: 0)? | apache2/apachev2/asl2/aslv2
bsd | [234] clause bsd(?: licen[cs]e)? | clause bsd
bsd | bsd(?: style)? licen[cs]e[ds]? | bsd
cc-by | cc by(?: [1234] [05])? | cc by
cddl | cddl(?: v?1(?: [01])?)? | cddl
copyleft | copyleft(?: licen[cs]e)? | copyleft
epl | epl v?[12](?: 0)? | epl
eupl | eupl(?: v?1(?: [012])?)? | eupl
gpl | gpl v?[123](?: 0)?(?: or later| only)? | gpl
gpl | gplv?[123](?: 0)?(?: or later| only)? | gplv1/gplv2/gplv3/gpl1/gpl2/gpl3
gpl | gpl(?:ed)?(?: licen[cs]e[ds]?)? | gpl/gpled
gpl | gnu gpl | gnu gpl
lgpl | lgpl(?: v?[23](?: [01])?)?(?: or later| only)? | lgpl
lgpl | lgplv?[23](?: [01])?(?: or later| only)? | lgplv2/lgplv3/lgpl2/lgpl3
mit | mit style licen[cs]e[ds]? | mit style
mit | (?:licensed|released|distributed|available) under (?:the )?mit | mit under
mpl | mpl v?[12](?: [01])? | mpl
odbl | odbl | odbl
ofl | (?:sil )?ofl(?: v?1(?: [01])?)? | ofl
osl | osl v?3(?: 0)? | osl
public-domain | public domain | public domain
unlicense | unlicense | unlicense
wtfpl | wtfpl(?: v2| 2 0)? | wtfpl
"""

# Weak hints: label | pattern | words.
HINTS = """
license-notice | (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:[^ ]+ ){0,5}licen[cs]e | license/licence under licensed/released/distributed/available
license-notice | see (?:the )?(?:file )?licen[cs]e(?: txt| md)?(?: file)? for (?:more )?details | license/licence see details
license-notice | (?:subject to|in accordance with|under) the (?:following )?terms and conditions | terms conditions
license-notice | this (?:[^ ]+ ){1,3}is licensed under | licensed under
license-notice | open source licen[cs]e | license/licence open source
license-notice | end user licen[cs]e agreement | agreement license/licence user
license-notice | eula | eula
license-notice | spdx license identifier | spdx identifier
license-notice | terms of (?:use|service) | terms use/service
license-notice | copyright (?:c )?(?:19|20)[0-9][0-9] | copyright
"""


def _rows(text: str) -> Iterable[tuple[str, str, tuple[frozenset[str], ...]]]:
    """Label, pattern and words; a pattern may hold bars, the cells beside it none."""
    for line in text.strip().splitlines():
        label, rest = line.split("|", 1)
        pattern, words = rest.rsplit("|", 1)
        yield label.strip(), pattern.strip(), groups_of(words)


def _commons() -> Iterable[Rule]:
    """Every attribution license: with parts, with and without versions, as identifier, title, address and name."""
    for parts in ((), ("sa",), ("nd",), ("nc",), ("nc", "sa"), ("nc", "nd")):
        label, short = "-".join(["cc-by", *parts]), " ".join(["by", *parts])
        title = " ".join(["attribution", *(COMMONS[p] for p in parts)])
        for version in COMMONS_VERSIONS:
            full = f"{label}-{version.replace(' ', '.')}"
            yield Rule(IDENTIFIER, full, f"(?:spdx license identifier )?cc {short} {version}", groups_of(f"cc {short}"))
            yield Rule(TITLE, full, f"(?:creative commons )?{title} {version}", groups_of("attribution"))
            yield Rule(ADDRESS, full, f"creativecommons org licenses {short} {version}", groups_of(f"creativecommons {short}"))
        yield Rule(TITLE, label, f"creative commons {title}(?: licen[cs]e)?", groups_of("commons creative attribution"))
        yield Rule(NAME, label, f"cc {short}", groups_of(f"cc {short}"))


def _licenses() -> Iterable[Rule]:
    """Each license by its identifiers behind a tag, by its title with a grant, by its title, and by an address that ends in an identifier."""
    for line in LICENSES.strip().splitlines():
        label, rest = line.split("|", 1)
        identifiers, rest = rest.split("|", 1)
        title, words = rest.rsplit("|", 1)
        label, title, words = label.strip(), title.strip(), words.strip()
        for identifier in map(str.strip, identifiers.split(",")):
            yield Rule(IDENTIFIER, label, f"spdx license identifier {identifier}", groups_of(f"spdx {identifier}"))
            yield Rule(ADDRESS, label, f"(?:opensource|spdx) org licenses? {identifier}(?: html| php| txt)?", groups_of(f"opensource/spdx {identifier}"))
        yield Rule(NOTICE, label, f"{GRANTED}{title}", groups_of(f"{words} under"))
        yield Rule(TITLE, label, f"{title}(?: v(?:ersion)?)?(?: [0-9]+)?(?: [0-9]+)?", groups_of(words))


@cache
def rules() -> list[Rule]:
    """All rules by tier; within a tier in the order in which they are written."""
    every = [*_licenses(), *_commons()]
    for tier, text in ((NOTICE, NOTICES), (ADDRESS, ADDRESSES), (NAME, NAMES), (HINT, HINTS)):
        every += [Rule(tier, label, pattern, words) for label, pattern, words in _rows(text)]
    every += [Rule(TITLE, label, phrase, groups_of(phrase)) for phrase, label in BASE.items()]
    return sorted(every, key=lambda rule: rule.tier)


def _compiled(pattern: str) -> re.Pattern:
    """Whole words: a match begins with the blank before its first word and ends before a blank."""
    return re.compile(f" (?:{pattern})(?= )".encode())


class Program:
    """The compiled rules, and for each word those whose first group holds it."""

    def __init__(self) -> None:
        self.rules = rules()
        self.patterns = [_compiled(rule.pattern) for rule in self.rules]
        self.groups = [[frozenset(w.encode() for w in group) for group in rule.words] for rule in self.rules]
        self.words = frozenset(w for groups in self.groups for group in groups for w in group)
        self.by_word: dict[bytes, list[int]] = {}
        for i, groups in enumerate(self.groups):
            for word in groups[0]:
                self.by_word.setdefault(word, []).append(i)
        self.base = {_compiled(phrase): label for phrase, label in BASE.items()}

    def able(self, words: list[bytes]) -> list[int]:
        """The rules whose words the text has, in order."""
        present = self.words.intersection(words)
        found = {i for w in present for i in self.by_word.get(w, ())}
        return sorted(i for i in found if not any(group.isdisjoint(present) for group in self.groups[i]))


program = cache(Program)

# Every byte but digits, letters and those beyond ASCII separates words.
_SEPARATED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def words_of(text: str) -> list[bytes]:
    """The words of a text, A to Z in lower case."""
    return text.encode().translate(_SEPARATED).split()


class Detection(NamedTuple):
    start: int
    stop: int
    order: int
    rule: Rule


def _joined(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def detect(words: list[bytes], able: Iterable[int] | None = None) -> list[Detection]:
    """All matches of the rules whose words are there, from word `start` to before word `stop`."""
    own = program()
    able = own.able(words) if able is None else able
    if not able or not words:
        return []
    text, out, at, word = _joined(words), [], 0, 0
    for start, stop, i in sorted((m.start(), m.end(), i) for i in able for m in own.patterns[i].finditer(text)):
        word += text.count(b" ", at, start)
        at = start
        out.append(Detection(word, word + text.count(b" ", start, stop), i, own.rules[i]))
    return out


def keep(found: list[Detection]) -> list[Detection]:
    """Those that do not lie within one of a higher tier, nor within a longer or earlier-written one of their own."""
    kept: list[Detection] = []
    for tier in sorted({d.rule.tier for d in found}):
        pool = kept + [d for d in found if d.rule.tier == tier]
        pool.sort(key=lambda d: (d.start, -d.stop, d.rule.tier, d.order))
        kept, reach = [], -1
        for d in pool:
            if d.rule.tier < tier or d.stop > reach:
                kept.append(d)
            reach = max(reach, d.stop)
    return kept


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """The words at which a BASE phrase starts, with its label."""
    if not words or _BASE_WORDS.isdisjoint(words):
        return []
    text, out, at, word = _joined(words), [], 0, 0
    for start, label in sorted((m.start(), label) for pattern, label in program().base.items() for m in pattern.finditer(text)):
        word += text.count(b" ", at, start)
        at = start
        out.append((word, label))
    return out


#: The rarest word of each phrase.
_BASE_WORDS = frozenset((b"general", b"apache", b"cc", b"mit"))


def scan(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and the detections that are left."""
    words = words_of(text)
    kept, places = keep(detect(words)), base_places(words)
    base = {label for _, label in places}
    labels = base | {d.rule.label for d in kept}
    score = max((CONFIDENCE[d.rule.tier] for d in kept), default=0.0)
    spans = [{"label": d.rule.label, "start": d.start, "length": d.stop - d.start} for d in sorted(kept, key=lambda d: (d.start, d.order))]
    first, last = (places[0][0], places[-1][0]) if places else (None, None)
    return len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


RESULT = T.StructType(
    [
        *(T.StructField(name, T.LongType()) for name in ("n_words", "n_base", "first_word", "last_word")),
        *(T.StructField(name, T.StringType()) for name in ("base_labels", "labels")),
        T.StructField("score", T.DoubleType()),
        T.StructField("detections", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))),
    ]
)


@F.arrow_udf(RESULT)
def _scanned(column: pa.Array) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    kind, parts = to_arrow_type(RESULT), []
    for batch in slices([pa.RecordBatch.from_arrays([column], ["text"])]):
        rows = [dict(zip(RESULT.names, scan(x))) for x in batch.column("text").to_pylist()]
        parts.append(pa.array(rows, kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def with_licenses(docs: DataFrame, text: str = "text", name: str = "licenses") -> DataFrame:
    """Every row of docs with a struct of what was found in its whole text; a column of that name is replaced.

    n_words; n_base, first_word and last_word: how often the BASE phrases occur, and the first and last word
    at which one starts (null if none); base_labels and labels: distinct, sorted, joined by commas, the
    latter with those of all rules; score: the confidence of the best detection, 0 without any; detections:
    label, first word and number of words of each. Words are runs of ASCII letters and digits and of
    characters beyond ASCII, A to Z in lower case. A null or empty text has no words. Rows are judged one
    by one, where they lie: no shuffle; repeated rows stay, an empty table stays empty.
    """
    return docs.withColumn(name, _scanned(text_of(text)))
