"""Ordered license rules: hand-written expressions over text in lower case, each behind one word that every match must hold.

A line is ``certainty | label | keyword | expression``; ``~`` in an expression stands for white space and comment marks between words,
so a keyword, which must occur literally, never spans one. An expression of alternatives without a word in common is several lines.
Earlier lines have priority. Families that differ only in parameters (identifiers, Creative Commons terms and versions) are
spelt by rule from their parts at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

GAP = r"[\s*#/>-]+"

_WRITTEN = r"""
0.99|mit-text|hereby|permission~is~hereby~granted,?~free~of~charge,?~to~any~person~obtaining~a~copy~of~this~software
0.97|mit-text|restriction|to~deal~in~the~software~without~restriction
0.95|mit-text|copyright|the~above~copyright~notice~and~this~permission~notice~shall~be~included
0.95|isc-text|distribute|permission~to~use,?~copy,?~modify,?~and(?:/or)?~distribute~this~software~for~any~purpose~with~or~without~fee
0.95|bsd-text|redistribution|redistribution~and~use~in~source~and~binary~forms
0.97|bsd-3-clause-text|contributors|neither~the~names?~of~[\s\S]{1,80}?~nor~the~names~of~(?:its|their)~contributors
0.97|bsd-4-clause-text|advertising|all~advertising~materials~mentioning~features~or~use~of~this~software
0.97|apache-2.0-text|applicable|unless~required~by~applicable~law~or~agreed~to~in~writing,?~software~distributed~under~the~license
0.95|apache-2.0-text|compliance|you~may~not~use~this~file~except~in~compliance~with~the~license
0.97|gpl-text|redistribute|this~(?:program|library|file)~is~free~software[;:,]?~you~can~redistribute~it~and/or~modify
0.95|gpl-text|received|you~should~have~received~a~copy~of~the~gnu~(?:lesser~|affero~|library~)?general~public~license
0.97|zlib-text|altered|altered~source~versions~must~be~plainly~marked~as~such
0.95|zlib-text|implied|this~software~is~provided~'?as-is'?,?~without~any~express~or~implied~warranty
0.98|unlicense-text|unencumbered|this~is~free~and~unencumbered~software~released~into~the~public~domain
0.98|wtfpl|fuck|do~what~the~fuck~you~want~to(?:~public~license)?
0.97|bsl-1.0-text|boost|permission~is~hereby~granted[\s\S]{1,200}?boost~software~license
0.97|mpl-2.0-text|mozilla|this~source~code~form~is~subject~to~the~terms~of~the~mozilla~public~license
0.97|ofl-1.1-text|font|with~reserved~font~names?
0.96|cc0-text|waive|waives?~all~(?:of~(?:his|her|their|its)~)?(?:copyright~and~related|rights)~[\s\S]{0,60}?to~the~work~worldwide
0.95|artistic-text|package|standard~version~of~the~package~without~restriction
0.95|openssl-text|openssl|this~product~includes~software~developed~by~the~openssl~project
0.95|warranty-disclaimer|merchantability|implied~warrant(?:y|ies)~of~merchantability
0.90|warranty-disclaimer|warranty|without~any~warranty
0.90|warranty-disclaimer|warranties|without~warranties~or~conditions~of~any~kind
0.90|warranty-disclaimer|provided|provided~"as~is"
0.90|liability-disclaimer|liable|in~no~event~shall~[\s\S]{1,120}?~be~liable
0.99|agpl-3.0-or-later|affero|gnu~affero~general~public~license,?~(?:version|v\.?)~?3(?:\.0)?,?~or~(?:\(at~your~option\)~)?any~later
0.98|agpl-3.0|affero|(?:gnu~)?affero~general~public~license,?~(?:version|v\.?)\s*3
0.95|agpl|affero|(?:gnu~)?affero~general~public~licen[cs]e
0.99|lgpl-2.1-or-later|lesser|lesser~general~public~license,?~(?:version|v\.?)\s*2\.1,?~or~(?:\(at~your~option\)~)?any~later
0.99|lgpl-3.0-or-later|lesser|lesser~general~public~license,?~(?:version|v\.?)\s*3(?:\.0)?,?~or~(?:\(at~your~option\)~)?any~later
0.98|lgpl-2.1|lesser|lesser~general~public~license,?~(?:version|v\.?)\s*2\.1
0.98|lgpl-3.0|lesser|lesser~general~public~license,?~(?:version|v\.?)\s*3
0.95|lgpl|lesser|(?:gnu~)?lesser~general~public~licen[cs]e
0.95|lgpl-2.0|library|(?:gnu~)?library~general~public~licen[cs]e
0.99|gpl-2.0-or-later|general|general~public~license,?~(?:version|v\.?)\s*2(?:\.0)?,?~or~(?:\(at~your~option\)~)?any~later
0.99|gpl-3.0-or-later|general|general~public~license,?~(?:version|v\.?)\s*3(?:\.0)?,?~or~(?:\(at~your~option\)~)?any~later
0.99|gpl-2.0-or-later|either|either~version~2~of~the~license,?~or
0.99|gpl-3.0-or-later|either|either~version~3~of~the~license,?~or
0.98|gpl-1.0|general|(?:gnu~)?general~public~licen[cs]e,?~(?:version|v\.?)\s*1
0.98|gpl-2.0|general|(?:gnu~)?general~public~licen[cs]e,?~(?:version|v\.?)\s*2
0.98|gpl-3.0|general|(?:gnu~)?general~public~licen[cs]e,?~(?:version|v\.?)\s*3
0.92|gpl|general|(?:gnu~)?general~public~licen[cs]e
0.95|gfdl-1.3|documentation|(?:gnu~)?free~documentation~license,?~(?:version|v\.?)\s*1\.3
0.95|gfdl-1.2|documentation|(?:gnu~)?free~documentation~license,?~(?:version|v\.?)\s*1\.2
0.93|gfdl|documentation|(?:gnu~)?free~documentation~licen[cs]e
0.97|agpl-3.0|agpl|\bagpl(?:v|-|~v(?:ersion~)?)?\s*3(?:\.0)?(?![\d.]*\d)
0.85|agpl|agpl|\bagpl\b
0.97|lgpl-3.0|lgpl|\blgpl(?:v|-|~v(?:ersion~)?)?\s*3(?:\.0)?(?![\d.]*\d)
0.97|lgpl-2.1|lgpl|\blgpl(?:v|-|~v(?:ersion~)?)?\s*2\.1
0.97|lgpl-2.0|lgpl|\blgpl(?:v|-|~v(?:ersion~)?)?\s*2(?:\.0)?(?![\d.]*\d)
0.85|lgpl|lgpl|\blgpl\b
0.97|gpl-3.0|gpl|\bgpl(?:v|-|~v(?:ersion~)?)?\s*3(?:\.0)?(?![\d.]*\d)
0.97|gpl-2.0|gpl|\bgpl(?:v|-|~v(?:ersion~)?)?\s*2(?:\.0)?(?![\d.]*\d)
0.85|gpl|gpl|\bgpl\b
0.97|gpl-classpath-exception|classpath|classpath~exception
0.97|gpl-gcc-exception|gcc|gcc~runtime~library~exception
0.99|apache-2.0|apache|apache~(?:software~)?licen[cs]e,?~\(?(?:version~|v\.?\s*)?2(?:\.0)?\)?
0.98|apache-1.1|apache|apache~(?:software~)?licen[cs]e,?~\(?(?:version~|v\.?\s*)?1\.1\)?
0.98|apache-1.0|apache|apache~(?:software~)?licen[cs]e,?~\(?(?:version~|v\.?\s*)?1\.0\)?
0.95|apache-2.0|apache|apache[- ]2(?:\.0)?~licen[cs]ed?
0.92|apache|apache|apache~(?:software~)?licen[cs]e
0.98|apache-2.0|apache.org|(?:https?://)?(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
0.90|apache|apache|licensed~to~the~apache~software~foundation
0.97|mit-0|mit|\bmit~no~attribution\b
0.97|mit|mit|(?:released|licensed|distributed|available|published)~under~(?:the~)?(?:terms~of~the~)?mit~licen[cs]e
0.95|mit|mit|\bmit~licen[cs]e
0.90|mit|mit|\bmit[- ]licen[cs]ed\b
0.85|mit|mit|\blicen[cs]e:\s*mit\b
0.90|mit|expat|\bexpat~licen[cs]e
0.95|x11|x11|\bx11~licen[cs]e
0.98|bsd-4-clause|bsd|\b(?:4|four)[- ]clause~bsd|bsd[- ](?:4|four)[- ]clause|original~bsd~licen[cs]e
0.98|bsd-3-clause|bsd|\b(?:3|three)[- ]clause~bsd|bsd[- ](?:3|three)[- ]clause|(?:new|modified|revised)~bsd~licen[cs]e
0.98|bsd-2-clause|bsd|\b(?:2|two)[- ]clause~bsd|bsd[- ](?:2|two)[- ]clause|(?:simplified~bsd|freebsd(?:~bsd)?)~licen[cs]e
0.98|bsd-2-clause|simplified|simplified~licen[cs]e
0.98|bsd-1-clause|bsd|\b(?:1|one)[- ]clause~bsd|bsd[- ](?:1|one)[- ]clause
0.98|0bsd|bsd|\b(?:0|zero)[- ]clause~bsd|bsd[- ](?:0|zero)[- ]clause|\b0bsd\b
0.90|bsd|bsd|\bbsd[- ](?:style~)?licen[cs]ed?
0.95|isc|isc|\bisc~licen[cs]e
0.97|mpl-2.0|mozilla|mozilla~public~licen[cs]e,?~(?:version~|v\.?\s*)?2(?:\.0)?
0.97|mpl-1.1|mozilla|mozilla~public~licen[cs]e,?~(?:version~|v\.?\s*)?1\.1
0.97|mpl-1.0|mozilla|mozilla~public~licen[cs]e,?~(?:version~|v\.?\s*)?1\.0
0.92|mpl|mozilla|mozilla~public~licen[cs]e
0.97|mpl-2.0|mozilla.org|mozilla\.org/mpl/2\.0
0.95|mpl-2.0|mpl|\bmpl[- ]?(?:v)?2(?:\.0)?\b
0.95|mpl-1.1|mpl|\bmpl[- ]?(?:v)?1\.1\b
0.97|epl-2.0|eclipse|eclipse~public~licen[cs]e,?~(?:-~)?(?:version~|v\.?\s*)?2\.0
0.97|epl-1.0|eclipse|eclipse~public~licen[cs]e,?~(?:-~)?(?:version~|v\.?\s*)?1\.0
0.92|epl|eclipse|eclipse~public~licen[cs]e
0.95|edl-1.0|eclipse|eclipse~distribution~licen[cs]e
0.97|eupl-1.2|european|european~union~public~licen[cs]e,?~(?:version~|v\.?\s*)?1\.2
0.97|eupl-1.1|european|european~union~public~licen[cs]e,?~(?:version~|v\.?\s*)?1\.1
0.92|eupl|european|european~union~public~licen[cs]e
0.97|cddl-1.1|development|common~development~and~distribution~license,?~\(?(?:cddl\)?,?~)?(?:version~|v\.?\s*)?1\.1
0.97|cddl-1.0|development|common~development~and~distribution~license,?~\(?(?:cddl\)?,?~)?(?:version~|v\.?\s*)?1\.0
0.92|cddl|development|common~development~and~distribution~licen[cs]e
0.85|cddl|cddl|\bcddl\b
0.95|cpl-1.0|common|common~public~licen[cs]e
0.95|ipl-1.0|ibm|ibm~public~licen[cs]e
0.95|artistic-2.0|artistic|artistic~licen[cs]e,?~(?:version~|v\.?\s*)?2(?:\.0)?
0.95|artistic-1.0|artistic|artistic~licen[cs]e,?~(?:version~|v\.?\s*)?1(?:\.0)?
0.88|artistic|artistic|artistic~licen[cs]e
0.90|perl|perl|under~the~same~terms~as~perl~itself
0.97|bsl-1.0|boost|boost~software~licen[cs]e(?:,?~(?:-~)?(?:version~|v\.?\s*)?1\.0)?
0.97|busl-1.1|business|business~source~licen[cs]e(?:,?~(?:version~|v\.?\s*)?1\.1)?
0.97|sspl-1.0|server|server~side~public~licen[cs]e
0.95|elastic-2.0|elastic|elastic~licen[cs]e,?~(?:version~|v\.?\s*)?2(?:\.0)?
0.90|elastic|elastic|elastic~licen[cs]e
0.95|commons-clause|commons|commons~clause~licen[cs]e~condition|commons~clause
0.95|polyform-noncommercial|polyform|polyform~noncommercial~licen[cs]e
0.95|polyform-small-business|polyform|polyform~small~business~licen[cs]e
0.95|polyform-shield|polyform|polyform~shield~licen[cs]e
0.95|prosperity|prosperity|prosperity~public~licen[cs]e
0.95|parity|parity|parity~public~licen[cs]e
0.95|zlib|zlib|\bzlib(?:/libpng)?~licen[cs]e
0.95|libpng|libpng|\blibpng~licen[cs]e
0.95|openssl|openssl|\bopenssl~licen[cs]e
0.95|ssleay|ssleay|(?:original~)?ssleay~licen[cs]e
0.95|curl|curl|\bcurl~licen[cs]e
0.95|php-3.01|php|\bphp~licen[cs]e,?~(?:version~|v\.?\s*)?3\.01
0.93|php|php|\bphp~licen[cs]e
0.95|python-2.0|python|python~(?:software~foundation~)?licen[cs]e
0.93|psf|psf|\bpsf~licen[cs]e
0.93|ruby|ruby|\bruby(?:'s)?~licen[cs]e
0.95|vim|vim|\bvim~licen[cs]e
0.95|tcl|tcl|\btcl(?:/tk)?~licen[cs]e
0.95|ncsa|ncsa|(?:university~of~illinois/)?ncsa~(?:open~source~)?licen[cs]e
0.95|upl-1.0|permissive|universal~permissive~licen[cs]e
0.95|unlicense|unlicense|\b(?:the~)?unlicense\b
0.95|afl-3.0|academic|academic~free~licen[cs]e,?~(?:version~|v\.?\s*)?3\.0
0.92|afl|academic|academic~free~licen[cs]e
0.95|osl-3.0|open|open~software~license,?~(?:version~|v\.?\s*)?3\.0
0.92|osl|open|open~software~license
0.95|ecl-2.0|educational|educational~community~licen[cs]e
0.95|ms-pl|microsoft|microsoft~public~licen[cs]e
0.95|ms-rl|reciprocal|microsoft~reciprocal~licen[cs]e
0.95|wxwindows|wxwindows|wxwindows~library~licen[cs]e
0.95|qpl-1.0|public|\bq~public~licen[cs]e
0.95|sleepycat|sleepycat|sleepycat~licen[cs]e
0.95|postgresql|postgresql|postgresql~licen[cs]e
0.95|beerware|beer|beer-?ware~licen[cs]e
0.95|json|json|\bjson~licen[cs]e
0.95|json|evil|shall~be~used~for~good,?~not~evil
0.95|ofl-1.1|font|(?:sil~)?open~font~licen[cs]e(?:,?~(?:version~|v\.?\s*)?1\.1)?
0.95|lppl|latex|latex~project~public~licen[cs]e
0.95|odbl-1.0|database|open~(?:data~commons~)?(?:open~)?database~licen[cs]e
0.95|odc-by-1.0|commons|open~data~commons~attribution~licen[cs]e
0.95|pddl-1.0|commons|open~data~commons~public~domain~dedication
0.95|cdla-permissive|agreement|community~data~license~agreement~(?:-|–)?~?permissive
0.95|cdla-sharing|agreement|community~data~license~agreement~(?:-|–)?~?sharing
0.95|ogl-uk-3.0|government|open~government~licen[cs]e(?:,?~(?:version~|v\.?\s*)?3(?:\.0)?)?
0.95|etalab-2.0|ouverte|licence~ouverte
0.95|etalab-2.0|etalab|etalab~(?:open~)?licen[cs]e
0.95|cecill-2.1|cecill|\bcecill(?:-[bc])?(?:~licen[cs]e)?
0.95|openrail|openrail|\b(?:creativeml~)?openrail(?:-?m|\+\+-?m)?\b
0.95|llama-community|llama|llama~[\d.]*~?community~licen[cs]e
0.95|gemma-terms|gemma|gemma~terms~of~use
0.93|hippocratic|hippocratic|hippocratic~licen[cs]e
0.93|anti-996|anti-996|anti-996~licen[cs]e
0.93|mulan-psl-2.0|mulan|mulan~(?:psl|permissive~software~licen[cs]e)
0.93|blueoak-1.0.0|oak|blue~oak~model~licen[cs]e
0.93|ncl|commercial|non-?commercial~(?:use~)?licen[cs]e
0.90|noncommercial-use|commercial|(?:for~)?non-?commercial~(?:use|purposes)~only
0.90|research-only|research|for~(?:academic~)?research~(?:use|purposes)~only
0.90|personal-use|personal|for~personal~use~only
0.85|internal-use|internal|for~internal~use~only
0.90|eula|agreement|end[- ]user~licen[cs]e~agreement
0.85|shareware|shareware|\bshareware\b
0.80|freeware|freeware|\bfreeware\b
0.95|public-domain|domain|(?:released|dedicated|placed|donated)~(?:in)?to~the~public~domain
0.90|public-domain|domain|(?:is|are)~in~the~public~domain
0.75|public-domain|domain|\bpublic~domain\b
0.93|proprietary|proprietary|proprietary~and~confidential
0.90|proprietary|proprietary|proprietary~(?:software~)?licen[cs]e
0.90|proprietary|unauthori|unauthori[sz]ed~(?:copying|use|reproduction|distribution)~[\s\S]{0,60}?~(?:is~)?(?:strictly~)?prohibited
0.88|proprietary|reproduced|(?:may|must)~not~be~reproduced~[\s\S]{0,80}?without~[\s\S]{0,40}?permission
0.85|all-rights-reserved|reserved|\ball~rights~reserved\b
0.85|some-rights-reserved|reserved|\bsome~rights~reserved\b
0.85|all-rights-reserved|vorbehalten|\balle~rechte~vorbehalten\b
0.85|all-rights-reserved|droits|\btous~droits~r(?:é|e)serv(?:é|e)s\b
0.85|all-rights-reserved|derechos|\btodos~los~derechos~reservados\b
0.75|copyright-notice|copyright|\bcopyright~(?:\(c\)~|©~?)?(?:19|20)\d\d
0.75|copyright-notice|copyright|\(c\)~copyright\b|©~copyright\b
0.70|copyright-notice|©|©~?(?:19|20)\d\d
0.95|mit-cmu|cmu|\bcmu~licen[cs]e
0.95|hpnd|historical|historical~permission~notice~and~disclaimer
0.95|ntp|ntp|\bntp~licen[cs]e
0.95|icu|icu|\bicu~licen[cs]e
0.95|unicode|unicode|unicode~(?:data~files~and~software~)?licen[cs]e
0.95|w3c|w3c|\bw3c~software~(?:notice~and~)?(?:document~)?licen[cs]e
0.95|ijg|jpeg|independent~jpeg~group(?:'s)?~(?:software~)?licen[cs]e
0.95|libtiff|libtiff|\blibtiff~licen[cs]e
0.95|ftl|freetype|freetype~(?:project~)?licen[cs]e
0.95|imagemagick|imagemagick|imagemagick~licen[cs]e
0.95|oldap|openldap|openldap~public~licen[cs]e
0.95|net-snmp|snmp|net-snmp~licen[cs]e
0.95|zpl|zope|zope~public~licen[cs]e
0.95|sissl|industry|sun~industry~standards~source~licen[cs]e
0.95|spl-1.0|sun|sun~public~licen[cs]e
0.95|apsl|apple|apple~public~source~licen[cs]e
0.95|npl|netscape|netscape~public~licen[cs]e
0.95|nokia|nokia|nokia~open~source~licen[cs]e
0.95|rpl|reciprocal|reciprocal~public~licen[cs]e
0.95|simpl|simple|simple~public~licen[cs]e
0.95|watcom|watcom|(?:sybase~)?open~watcom~public~licen[cs]e
0.95|vsl|vovida|vovida~software~licen[cs]e
0.95|intel|intel|intel~open~source~licen[cs]e
0.95|lpl|lucent|lucent~public~licen[cs]e
0.95|motosoto|motosoto|motosoto~open~source~licen[cs]e
0.95|naumen|naumen|naumen~public~licen[cs]e
0.95|rscpl|ricoh|ricoh~source~code~public~licen[cs]e
0.95|rpsl|realnetworks|realnetworks~public~source~licen[cs]e
0.95|eudatagrid|datagrid|eu~datagrid~software~licen[cs]e
0.95|entessa|entessa|entessa~public~licen[cs]e
0.95|frameworx|frameworx|frameworx~open~licen[cs]e
0.95|cua-opl|cua|cua~office~public~licen[cs]e
0.95|ogtsl|suite|open~group~test~suite~licen[cs]e
0.95|oclc|oclc|oclc~(?:research~)?public~licen[cs]e
0.95|aal|assurance|attribution~assurance~licen[cs]e
0.95|catosl|associates|computer~associates~trusted~open~source~licen[cs]e
0.93|gpl-font-exception|font|\bfont~(?:embedding~)?exception
0.93|gpl-linking-exception|linking|\blinking~exception
0.93|llvm-exception|llvm|\bllvm~exceptions?
0.60|license-file|file|see~(?:the~)?(?:accompanying~)?licen[cs]e~file
0.60|license-mention|licensed|\b(?:dual[- ])?licensed~under\b
"""

# Parts of the families. Public license identifiers and Creative Commons terms.
_IDENTIFIERS = (
    "0bsd afl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-2-clause bsd-3-clause bsd-4-clause "
    "bsl-1.0 busl-1.1 cc-by-4.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nd-4.0 cc0-1.0 cddl-1.0 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 "
    "gfdl-1.3-only gpl-1.0-only gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later isc lgpl-2.0-only lgpl-2.1-only lgpl-2.1-or-later "
    "lgpl-3.0-only lgpl-3.0-or-later lppl-1.3c mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 osl-3.0 php-3.01 postgresql "
    "python-2.0 sspl-1.0 unlicense upl-1.0 vim wtfpl zlib"
).split()
_CC_TERMS = {
    "by": "attribution", "by-sa": "attribution[- ]share[- ]?alike", "by-nd": "attribution[- ]no[- ]?deriv(?:ative)?s?(?:~works)?",
    "by-nc": "attribution[- ]non-?commercial", "by-nc-sa": "attribution[- ]non-?commercial[- ]share[- ]?alike",
    "by-nc-nd": "attribution[- ]non-?commercial[- ]no[- ]?deriv(?:ative)?s?(?:~works)?",
}
_CC_VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0")


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    keyword: str
    pattern: str
    certainty: float


def _escape(text: str) -> str:
    return text.replace(".", r"\.").replace("+", r"\+")


def _families() -> list[tuple[float, str, str, str]]:
    out = [(0.99, i, "spdx-license-identifier", rf"spdx-license-identifier:\s*\(?{_escape(i)}(?![\w.+-])") for i in sorted(_IDENTIFIERS, key=lambda i: (-len(i), i))]
    for terms in sorted(_CC_TERMS, key=lambda t: -len(t)):
        for version in _CC_VERSIONS:
            label, v = f"cc-{terms}-{version}", _escape(version)
            short = "[- ]".join(["cc", *terms.split("-")])
            out += [
                (0.98, label, "creativecommons.org", rf"creativecommons\.org/licenses/{terms}/{v}"),
                (0.98, label, "creative", rf"creative~commons~{_CC_TERMS[terms]}~(?:licen[cs]e,?~)?(?:version~|v\.?\s*)?{v}"),
                (0.97, label, f"cc {terms[:2]}", rf"\b{short}[- ]?{v}"),
                (0.97, label, f"cc-{terms[:2]}", rf"\b{short}[- ]?{v}"),
            ]
    for terms in sorted(_CC_TERMS, key=lambda t: -len(t)):
        out.append((0.93, f"cc-{terms}", "creative", rf"creative~commons~{_CC_TERMS[terms]}"))
    out += [
        (0.98, "cc0-1.0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0"),
        (0.95, "cc0-1.0", "cc0", r"\bcc0(?:[- ]1\.0)?\b"),
        (0.90, "cc", "creative", r"creative~commons~(?:public~)?licen[cs]e"),
        (0.80, "cc", "creative", r"\bcreative~commons\b"),
    ]
    return out


def rules() -> list[Rule]:
    """All rules in order of priority."""
    rows = [(float(c), label, keyword, pattern) for c, label, keyword, pattern in (line.split("|", 3) for line in _WRITTEN.strip().splitlines())]
    return [Rule(i, label, keyword, pattern.replace("~", GAP), c) for i, (c, label, keyword, pattern) in enumerate(_families() + rows)]
