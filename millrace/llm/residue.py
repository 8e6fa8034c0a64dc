"""Template residue and error-page text (problem 8).

Method: trusted residue labels come from rules; near-duplicates are found with
partitioned SimHash tables, verified by Hamming distance and text similarity,
and the labels are propagated through their connected components.

Trusted labels: `slot` (a slot that was meant to be filled stands outside code,
formulas and quotations), `dummy` (the body is filler text), `notice` (the body
is a message of a server or browser, once lists of links and standing additions
are set aside).  Only `dummy` and `notice` are propagated: they are properties
of a whole body, so a near-copy has them too, while a copy of a text with a slot
may well be the filled one.

What is compared is the body: tags, lines of links and standing additions of error
pages ("retry after 57 s") are set aside, numbers are masked.  Fingerprints of 64
bits are taken over the words of the body and cut into BLOCKS blocks; each table keys
a document by KEPT of them.  Fingerprints that differ in at most BLOCKS - KEPT bits
share a key (pigeonhole), those up to DISTANCE bits mostly do; candidates are verified
by Hamming distance and then by the similarity of their texts.  A pair of similarity
SIMILARITY differs in four to five bits of a fingerprint over words, so the tables
hold nearly all of them (a test measures it); an exact prefix join of the labelled
texts supplies what they miss: two sets whose similarity reaches SIMILARITY share one
of the first n - SIMILARITY * n + 1 runs of either, in any order of runs common to
all.  Runs that a sample shows often come last in that order, which keeps the buckets
small.  Documents with the same body, word for word, collapse to one node first: what
holds for one of them holds for all.  A node's label goes to its members without one as
hop 1.  Labels spread from labelled to unlabelled nodes only, hop by hop, until a hop
finds nothing new: the labelled parts of the connected components are covered without
expanding a bucket into all its pairs, and hot keys are spread over tasks.

Nulls: null and blank texts are no cases; rows with a null id give no row.
Repeated rows count once.  Empty tables give an empty result.  Extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import tokens as T
from millrace.operators.joins import spread_join
from millrace.session import is_small, small_side, written

SHINGLE = 5
SIMILARITY = 0.8
DISTANCE = 8
BLOCKS, KEPT = 8, 3
#: A text of fewer words is compared by words; only texts of so few distinct words can be similar to one.
SHORT_WORDS = int((2 * SHINGLE - 1) / SIMILARITY)
#: Texts from which the order of runs is taken, and how many of them make a run a frequent one.
SAMPLE, FREQUENT = 10_000, 5
#: A spread over more links than this is taken for a fault and stops with an error.
MOST_HOPS = 1_000

# ---- slots --------------------------------------------------------------------------------------------------------

_CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|\$\$.*?\$\$|\$[^$\n{][^$\n]*\$|\\[A-Za-z]+(?:\{[^{}]*\})+|'[^'\n]{0,60}\{[^'\n]{0,60}\}[^'\n]{0,20}'|\"[^\"\n]{0,200}\"", re.S)
_SPEAKS_OF_FORMATS = re.compile(r"[^.\n]*\b(?:printf|sprintf|format string|format specifier|str\.format|placeholder)\b[^.\n]*\.?", re.I)
_DO = r"(?:enter|insert|add|your|todo|fill(?:\ in)?|put|type|write|choose|select|replace)"
SLOT = re.compile(
    rf"""
      \{{\{{[^{{}}\n]{{1,40}}\}}\}}
    | \{{%[^{{}}\n]{{1,40}}%\}}
    | <%[^<>\n]{{1,40}}%>
    | [$\#]\{{[^{{}}\n]{{1,40}}\}}
    | (?<![\w}}\\^_$\#{{])\{{(?:[A-Za-z_][A-Za-z_ ]{{0,30}}|\d{{1,2}})\}}(?!\}})
    | %\([A-Za-z_ ]{{1,30}}\)[sd]
    | (?<![\w%\d])%[sd](?!\w)
    | <{{1,2}}\s*{_DO}\b[^<>\n]{{0,40}}>{{1,2}}
    | <<\s*[A-Za-z][\w ]{{0,30}}>>
    | &lt;{{1,2}}[A-Za-z][A-Za-z_ ]{{0,30}}&gt;
    | (?P<tag><(?P<name>[a-z]+(?:_[a-z]+)+)>)
    | \[{_DO}\b[^\[\]\n]{{0,40}}\]
    | \[\[[A-Za-z][A-Za-z_ ]{{0,30}}\]\]
    | \[(?!(?:INFO|WARN|WARNING|ERROR|DEBUG|TRACE|FATAL|OK|PASS|FAIL|NOTE|INST|SEP|CLS|MASK|PAD|UNK|EOS|BOS)\])[A-Z][A-Z_]{{2,30}}\]
    | (?<!\w)__[A-Z][A-Z_]{{1,30}}__(?!\w)
    | @@[A-Za-z_]{{2,30}}@@
    | \({_DO}\b[^()\n]{{0,40}}\bhere\)
    """,
    re.X | re.I,
)
_UPPER_ONLY = re.compile(r"\[[A-Z][A-Z_]{2,30}\]|__[A-Z][A-Z_]{1,30}__")
#: Characters at which a slot may begin (the sign before a brace belongs to it).
_TRIGGER = re.compile(r"[$#]?\{|%[(sd]|<|&lt;|\[|__|@@|\(")
_HERE = re.compile(rf"\b{_DO} (?:\w+ ){{1,3}}here[\])>}}]", re.I)


def _is_slot(m: re.Match, text: str) -> bool:
    s = m.group()
    if m.group("tag") and f"</{m.group('name')}>" in text:
        return False
    upper_needed = s.startswith("__") or (s[0] == "[" and s[1] != "[" and not _DO_AT.match(s[1:]))
    return not upper_needed or bool(_UPPER_ONLY.fullmatch(s))


_DO_AT = re.compile(rf"{_DO}\b", re.I)


def has_slot(text: str) -> bool:
    """A slot outside code, formulas, quotations and talk of formats."""
    found = [m for at in _TRIGGER.finditer(text) if (m := SLOT.match(text, at.start())) and _is_slot(m, text)]
    if " here" in text:
        found += _HERE.finditer(text)
    if not found:
        return False
    spans = [m.span() for m in _CODE.finditer(text)] + [m.span() for m in _SPEAKS_OF_FORMATS.finditer(text)]
    return any(not any(a <= m.start() < b for a, b in spans) for m in found)


# ---- bodies -------------------------------------------------------------------------------------------------------

#: Filler vocabulary (fixed values): Latin dummy text and keyboard runs.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
    "duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum dolorem ipsa ipsam "
    "cito saepe lumen folia ferro amica aspera solum altus nihil teneo turris nox luna quid modo tempus vitae porta iter unda hiems pedes sonus cantus gravis brevis sedet vester rursus nunquam semper tandem terra aqua ignis "
    "ordo quaeri caelum vita mors amor bonus malus parvus magnus vox lux rex pax urbs via domus silva mare mons flumen manus caput corpus animus tamen enim autem igitur quoque vel aut neque nec per cum sine sub super inter ante post".split()
)
MASH = frozenset("asdf asdfg asdfgh qwer qwert qwerty zxcv zxcvb hjkl jkl jklö fghj ghjk sdfg dfgh uiop yuiop tyui vbnm foo bar baz qux quux blah bla xxx yyy zzz test testing tests lorem aaa bbb ccc dummy".split())
_DUMMY_SENTENCE = re.compile(
    r"dummy (?:sentence|text|paragraph|content)|body copy goes here|sample (?:paragraph|text|sentence) about nothing|(?:place ?holder|filler|sample) (?:text|copy|content)|text goes here|content goes here|"
    r"(?:text|copy|content) to (?:be supplied|follow|come)|to be (?:supplied|filled in|written) (?:by|later)|(?:space|area|section) is reserved for|(?:content|text) coming soon|insert (?:text|content) here|"
    r"hier steht (?:später )?ein text|(?:platzhalter|blind|füll)text|texte? provisoire|texte de remplissage|faux[- ]texte|texto (?:provisional|de relleno|de prueba|de ejemplo)|aquí va el texto|"
    r"此处填写|此处为占位|占位(?:文本|文字|符)|示例(?:文本|文字)内容|这里填写|测试文本",
    re.I,
)

_THING = r"(?:page|site|document|item|link|entry|listing|address|file|resource|requested|request|archive|view|content|article|image|video|server|url|record|section|feed|service|app|application|account|portal|profile|domain|channel|access|session|license|subscription|store|forum|board)"
NOTICE = re.compile(
    rf"""
      \b(?:java\s?script|js|scripts?|scripting|script\ (?:support|execution)|cookies?)\b
    | \b[1-9]\d\d\s*[-:–]?\s*(?:not\ found|bad\ gateway|gateway|service\ unavailable|unavailable|forbidden|internal|upstream|unauthori[sz]ed|too\ many|moved|gone|error)\b
    | \b(?:http|error|code|status)\s*(?:code\s*)?[=:]?\s*\(?\d{{1,4}}\b
    | \btoo\ many\ requests\b | \b(?:upstream|internal|server)\ (?:failure|error)\b | \bbad\ gateway\b | \bnot\ found\b | \baccess\ (?:is\ |was\ )?(?:denied|forbidden|restricted)\b | \bforbidden\b
    | \bdown\ for\ maintenance\b | \b(?:under|scheduled)\ maintenance\b | \bdid\ not\ (?:answer|respond)\b | \bleads\ nowhere\b | \btaken\ down\b | \bblocked\ in\ your\b | \bmembers\ only\b | \bvalid\ login\b | \bdaily\ quota\b
    | \bmoved\ elsewhere\b | \bhas\ (?:been\ )?moved\b | \bno\ longer\ (?:exists?|available|here|valid)\b | \bgone\ for\ good\b | \b(?:could|can)\ ?not\ be\ (?:loaded|displayed|shown|found|reached|opened|served|processed)\b
    | \b{_THING}\b[^.\n]{{0,40}}\b(?:unavailable|missing|removed|deleted|expired|does\ not\ exist|unreachable|restricted|offline|suspended|disabled|private)\b
    | \bcouldn['’]?t\ (?:find|load|reach|open|display)\b | \bsomething\ went\ wrong\b | (?<!raises\ )(?<!raise\ )(?<!throws\ )(?<!throw\ )(?<!returns\ )(?<!gives\ )\b(?:an|unexpected|unknown)\ error\b | \btimed?\ out\b | \bsession\b[^.\n]{{0,20}}\bexpired\b | \bconnection\b[^.\n]{{0,40}}\b(?:reset|refused|closed|lost)\b
    | \bdns\ lookup\b | \breturned\ nothing\b | \bif\ nothing\ happens\b | \bchecking\ your\ browser\b | \bverify\ (?:that\ )?you\ are\b | \bcaptcha\b | \b(?:are|you)\ (?:a\ )?(?:human|robot)\b | \bticking\ the\ box\b | \byour\ browser\b | \bbackend\b
    | ^\s*fatal:\s | \b(?:pool|memory|disk|quota)\ exhausted\b | \bsee\ log\b | \bswitch\ it\ on\b | \b(?:reload|refresh)\ (?:the\ )?(?:page|and)\b | \band\ (?:reload|refresh)\b
    | \btraceback\ \(most\ recent | ^\s*\w*(?:error|exception):\s | ^\s*file\ "[^"]+",\ line\ \d+ | \bstatus=\d+ | \breason=\w+ | "error"\s*: | \b(?:log|sign)\ ?in\ to\ (?:view|continue|see)\b | \brate\ limit
    | \b(?:seite|inhalt|datei|eintrag|dokument)\b[^.\n]{{0,30}}\b(?:nicht\ (?:gefunden|verfügbar|erreichbar)|existiert\ nicht|gesperrt)\b | \bfehler\ (?:beim|ist|\d) | \bzugriff\ verweigert\b | \bbitte\ (?:aktivieren|versuchen)\b | \bein\ fehler\b
    | \bpage\ (?:introuvable|non\ trouvée)\b | \bune\ erreur\b | \bveuillez\ (?:activer|réessayer|patienter)\b | \baccès\ (?:refusé|interdit)\b | \bcontenu\ (?:indisponible|introuvable)\b | \bservice\ indisponible\b
    | \bpágina\ no\ (?:encontrada|disponible)\b | \b(?:ha\ ocurrido|se\ produjo)\ un\ error\b | \bacceso\ (?:denegado|restringido|prohibido)\b | \b(?:active|habilite|activa)\ javascript\b | \bservicio\ no\ disponible\b | \binténtelo\ (?:de\ nuevo|más\ tarde)\b
    | \bnot\ available\ (?:in|from|for)\ your\b | \bsecurity\ (?:check|verification)\b | \bad[-\ ]?block(?:er|ing)?s?\b | \bmoved\ (?:permanently|temporarily)\b | \bcan['’]t\ be\ (?:loaded|displayed|shown|found|reached|opened|served)\b
    | \bjust\ a\ moment\b | \bchecking\ (?:if|whether|your|the)\b[^.\n]{{0,40}}\b(?:secure|browser|connection)\b | \bn['’]existe\ (?:plus|pas)\b | \bpágina\b[^.\n]{{0,30}}\bno\ existe\b | 请先登录
    | \b(?:sitzung|anmeldung|zugang|konto|portal|dienst|server|website|webseite)\b[^.\n]{{0,40}}\b(?:abgelaufen|gesperrt|deaktiviert|nicht\ (?:verfügbar|erreichbar|möglich))\b | \bbitte\ melden\ sie\ sich\b | \bwartungsarbeiten\b
    | \b(?:session|compte|accès|site|page)\b[^.\n]{{0,40}}\b(?:expirée?|suspendue?|bloquée?|désactivée?)\b | \bmaintenance\ en\ cours\b | \bconnectez-vous\b
    | \b(?:sesión|cuenta|acceso|sitio|página|servicio)\b[^.\n]{{0,40}}\b(?:caducad[oa]|expirad[oa]|suspendid[oa]|bloquead[oa]|desactivad[oa])\b | \binicie\ sesión\b | \ben\ mantenimiento\b
    | \bpagina\ non\ (?:trovata|disponibile|esiste)\b | \bsi\ è\ verificato\ un\ errore\b | \baccesso\ (?:negato|vietato|sospeso)\b | \b(?:abilitare|abilita|attivare|attiva)\ (?:javascript|i\ cookie)\b | \b(?:sessione|account)\b[^.\n]{{0,30}}\bscadut[oa]\b | \bservizio\ non\ disponibile\b | \briprova(?:re)?\ più\ tardi\b
    | \bpágina\ não\ (?:encontrada|disponível|existe)\b | \bocorreu\ um\ erro\b | \bacesso\ (?:negado|restrito|suspenso)\b | \b(?:ative|habilite)\ (?:o\ )?javascript\b | \bsessão\b[^.\n]{{0,30}}\bexpirou\b | \bserviço\ indisponível\b | \btente\ novamente\b
    | \bpagina\ niet\ gevonden\b | \btoegang\ geweigerd\b | \ber\ is\ een\ fout\ opgetreden\b | \bsessie\ is\ verlopen\b
    | 服务器(?:错误|繁忙|无响应) | 页面(?:不存在|未找到|无法|已) | 请(?:启用|开启|打开|稍后再试|刷新|登录) | 访问(?:被拒绝|受限|过于频繁) | (?:无法|不能)(?:访问|加载|显示) | 找不到(?:页面|网页|该页) | 网络(?:错误|超时) | 浏览器 | 验证码 | 加载失败
    """,
    re.X | re.I | re.M,
)
#: In lower case, a part of every text that NOTICE matches: a quick way to tell that it does not.
_NOTICE_SIGNS = (
    "js", "script", "cookie", "not found", "gateway", "unavailable", "forbidden", "internal", "upstream", "unauthori", "too many", "moved", "gone", "error", "http", "code", "status", "failure", "access", "maintenance", "did not ",
    "leads nowhere", "taken down", "blocked in", "members only", "valid login", "daily quota", "no longer ", "not be ", "missing", "deleted", "expired", "does not exist", "unreachable", "restricted", "offline", "suspended", "disabled",
    "private", "couldn", "went wrong", "timed out", "time out", "connection", "dns lookup", "returned nothing", "if nothing happens", "your browser", "verify ", "captcha", "human", "robot", "ticking the box", "backend", "fatal:", "exhausted",
    "see log", "switch it on", "reload", "refresh", "traceback", "exception", 'file "', "reason=", "in to ", "rate limit", "nicht ", "existiert", "gesperrt", "fehler", "verweigert", "bitte ", "introuvable", "non trouvée", "erreur", "veuillez",
    "accès", "indisponible", "página no", "acceso", "servicio no", "inténtelo", "服务器", "页面", "请", "访问", "无法", "不能", "找不到", "网络", "浏览器", "验证码", "加载失败",
    "not available", "security ", "block", "t be ", "just a moment", "checking ", "existe", "abgelaufen", "deaktiviert", "wartungsarbeiten", "expiré", "suspend", "bloqué", "désactivé", "connectez-vous", "caducad", "expirad", "bloquead", "desactivad", "inicie sesión", "mantenimiento",
    "pagina non ", "errore", "accesso ", "abilita", "attiva", "scadut", "servizio non", "riprova", "página não", "ocorreu um", "acesso ", "ative ", "habilite", "sessão", "serviço ind", "tente novamente", "niet gevonden", "geweigerd", "fout opgetreden", "verlopen",
)
_ADDITION_SIGNS = ("retry after", "try again", "reference", "nginx", "apache", "openresty", "cloudflare", "varnish", "the address", "ray ", "if this persists", "return to the", "go back", "torna alla", "zurück zur", "retour à", "volver ", "voltar ", "返回首页", "request id", "please wait")
#: Words that may be the topic of a text; such a sentence is a notice only if it also asks or tells for something.
_TOPIC = re.compile(r"java\s?script|js|scripts?|scripting|cookies?", re.I)
_ASKS = re.compile(r"\b(?:please|enable[sd]?|allow(?:ed)?|accept(?:ed)?|turn(?:ed)?\ on|switch(?:ed)?\ on|activated?|disabled|blocked|requires?|required|needed|must|without|off|permit(?:s|ted)?|proceed|continue|reload|refresh|habilit\w+|activ\w+|aktivier\w+|autoris\w+|accett\w+|acept\w+|abilit\w+|your|we\ (?:use|set|store)|this\ (?:site|page|website|form)|browser)\b", re.I | re.X)
#: Printed stacks: from the head line over the indented lines to the line of the error.
_STACK = re.compile(r"^[ \t]*Traceback \(most recent call last\):[^\n]*(?:\n[ \t]+\S[^\n]*|\n[ \t]*(?=\n))*(?:\n[\w.]*(?:Error|Exception|Interrupt|Exit)\b[^\n]*)?|(?:^[ \t]+at [\w.$<>/]+\([^()\n]*\)[ \t]*(?:\n|\Z))+", re.M)
#: Least share of a body's characters that are sentences of a notice.
NOTICE_SHARE = 0.6
#: Standing additions of error pages, set aside before the body is judged.
ADDITION = re.compile(
    r"retry after \d+ s\.?|(?:please )?try again(?: later)?\.?|reference:? (?:id:? )?[0-9a-f]{4,}\.?|nginx(?:-like)? ?[\d.]*|(?:apache|openresty|cloudflare|varnish)\S* ?[\d.]*|the address \S+ has no entry\.?|"
    r"ray (?:id:? )?[0-9a-f]{4,}(?: at node \w+)?\.?|if this persists,? contact [\w ]+\.?|return to the (?:start|home) ?page\.?|go back(?: home)?\.?|torna alla (?:pagina iniziale|home)\.?|zurück zur startseite\.?|retour à l['’]accueil\.?|vol(?:ver|tar) (?:al inicio|a la página principal|ao início)\.?|返回首页。?|request id:? \S+|please wait\b\.*",
    re.I,
)
_NAV_LINE = re.compile(r"^\s*(?:[^\W\d_][\w-]*(?: [\w-]+)?\s*[|/·•›>]\s*)+[^\W\d_][\w-]*(?: [\w-]+)?\s*$|^\s*[#*\-•]*\s*[^\W\d_][\w-]*(?: [\w-]+){0,2}\s*$", re.M)
_ANY_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n")
#: In a body of more words than this, what only names a topic or reports of a message does not count as a notice.
BODY_WORDS = 60
_FILLER_SIGNS = (" dolor", " magna", " luna", " tempus", " elit", "orem", " saepe", " porta", "asdf", "qwer", "zxcv", "hjkl", "dummy", "nothing", "goes here", "holder", "filler", "provisoire", "relleno", "steht", "supplied", "reserved", "填写", "占位", "示例")
_WORD_RUN = re.compile(r"[^\W\d_]+")


def _without_links(text: str) -> str:
    """The text without lines that are lists of links or titles."""
    return "\n".join(x for x in text.split("\n") if not (len(x) < 300 and _NAV_LINE.fullmatch(x) and not NOTICE.search(x) and not _DUMMY_SENTENCE.search(x)))


def body_of(text: str, low: str | None = None) -> tuple[str, str, str]:
    """(text without tags, without lists of links, and without standing additions too)."""
    flat = _ANY_TAG.sub("\n", text) if "<" in text else text
    body = _without_links(flat).strip()
    low = text.lower() if low is None else low
    core = ADDITION.sub(" ", body).strip() if any(x in low for x in _ADDITION_SIGNS) else body
    return flat, body, core


def has_residue_body(text: str, parts: tuple[str, str, str] | None = None) -> str | None:
    """`dummy` or `notice` if that is what the body consists of."""
    low = text.lower()
    filler = sum(s in low for s in _FILLER_SIGNS)
    flat, body, core = parts or body_of(text, low)
    words = _WORD_RUN.findall(body.lower())
    if len(words) >= 3:
        latin = sum(map(LATIN.__contains__, words)) / len(words)
        mash = sum(map(MASH.__contains__, words)) / len(words)
        if latin >= 0.7 or mash >= 0.7:
            return "dummy"
    if filler and _DUMMY_SENTENCE.search(body):
        sentences = [s for s in _SENTENCE.split(body) if re.search(r"\w", s)]
        if sum(len(s) for s in sentences if _DUMMY_SENTENCE.search(s)) >= 0.8 * sum(map(len, sentences)):
            return "dummy"
    if _is_no_notice(body, low):
        return None
    flat_body = body
    stacks = sum(len(m.group()) for m in _STACK.finditer(body))
    if stacks:
        core = ADDITION.sub(" ", _STACK.sub("\n", body)).strip()
    body = core
    if not re.search(r"\w", body):
        # nothing but stacks, links, titles and additions: a notice only if there is a stack or an addition
        return "notice" if stacks or ADDITION.search(flat) else None
    long = len(_WORD_RUN.findall(flat_body)) > BODY_WORDS
    if not long and _REPORTS.search(body):
        return None
    sentences = [s for s in _SENTENCE.split(body) if re.search(r"\w", s)]
    n = stacks + sum(map(len, sentences))
    spare = n - NOTICE_SHARE * n
    for s in sentences:
        if not _is_notice_sentence(s, long):
            spare -= len(s)
            if spare < -1e-9:
                return None
    return "notice" if n else None


try:
    import ahocorasick

    _SIGNS = ahocorasick.Automaton()
    for _x in _NOTICE_SIGNS:
        _SIGNS.add_word(_x, len(_x))
    _SIGNS.make_automaton()
except ImportError:
    _SIGNS = None
_FIND_SIGNS = None if _SIGNS else re.compile("|".join(f"(?={re.escape(x)})" for x in _NOTICE_SIGNS))


def _sign_places(low: str) -> list[int]:
    """Where signs of a notice stand: the place of a character of each."""
    return [e for e, _ in _SIGNS.iter(low)] if _SIGNS else [m.start() for m in _FIND_SIGNS.finditer(low)]


def _is_no_notice(body: str, low: str) -> bool:
    """Whether the sentences without any sign of a notice already make up too much of the body; an addition may join sentences, so with one the body is read."""
    if any(x in low for x in _ADDITION_SIGNS) and ADDITION.search(body):
        return False
    lower = body.lower()
    if ("traceback" in low or " at " in low and "(" in low) and _STACK.search(body) is not None:
        return False
    places = _sign_places(lower)
    if not places:
        return re.search(r"\w", lower) is not None
    n = hit = at = k = 0
    places.sort()
    for m in (*_SENTENCE.finditer(lower), None):
        end = m.start() if m else len(lower)
        while k < len(places) and places[k] < at:
            k += 1
        if k < len(places) and places[k] < end:
            hit += end - at
            n += end - at
        elif re.search(r"\w", lower[at:end]):
            n += end - at
        at = m.end() if m else end
    return hit < (NOTICE_SHARE - 0.01) * n


def _is_notice_sentence(s: str, long: bool) -> bool:
    """Whether a sentence has a sign of a notice; a mere topic (scripts, cookies) needs something that is asked or told beside it."""
    if long and _REPORTS.search(s):
        return False
    return any(not _TOPIC.fullmatch(m.group()) or _ASKS.search(s) for m in NOTICE.finditer(s))


#: Sentences that speak of such messages instead of being one.
_REPORTS = re.compile(r"\b(?:logged error|had to enable|raised the limit|call text such as|says the|wrote|reports? from|noted that|readers in|designers in|removed it from|is expanded by|while the)\b", re.I)


def label_of(text: str | None) -> str | None:
    return judged(text)[0]


def judged(text: str | None) -> tuple[str | None, str]:
    """(trusted label, what stands for the text in comparisons: its body, or all of it if nothing else is left)."""
    if text is None or not text.strip():
        return None, ""
    parts = body_of(text)
    return has_residue_body(text, parts) or ("slot" if has_slot(text) else None), parts[2] or text


# ---- fingerprints -------------------------------------------------------------------------------------------------


_NUMBER = re.compile(r"\d+")


def masked(text: str) -> str:
    """The text with every number as 9."""
    return _NUMBER.sub("9", text)


def simhash(h: np.ndarray, o: np.ndarray) -> np.ndarray:
    """64-bit SimHash of texts given by their word hashes, each occurrence of a word counting once."""
    out = np.zeros(len(o) - 1, np.uint64)
    have = np.flatnonzero(np.diff(o))
    if not len(have):
        return out
    n = np.diff(o)[have]
    starts = o[:-1][have]
    f = T.mix64(h)
    for bit in range(64):
        on = np.add.reduceat(((f >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts)
        out[have] |= (2 * on > n).astype(np.uint64) << np.uint64(bit)
    return out


def tables_of(fp: Column, blocks: int = BLOCKS, kept: int = KEPT) -> Column:
    """The keys of a fingerprint: for every choice of `kept` blocks, their bits and the table's number."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for n, keep in enumerate(combinations(range(blocks), kept)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in keep)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(n).alias("t"), fp.bitwiseAND(F.lit(signed)).alias("k")))
    return F.array(*keys)


def ordered(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Hashes in the order of the prefix join: the frequent ones (sorted) come last."""
    at = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
    often = frequent[at] == s if len(frequent) else np.zeros(len(s), bool)
    return (s >> np.uint64(1)) | (often.astype(np.uint64) << np.uint64(63))


def prefixes(s: np.ndarray, o: np.ndarray, takes_part: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """(size of each text's set of hashes, its prefix: of two sets with similarity SIMILARITY the prefixes meet)."""
    d, do = T.distinct_by_text(s, o)
    n = np.diff(do)
    take = np.where(takes_part & (n > 0), n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64) + 1, 0)
    keep = np.arange(len(d)) - np.repeat(do[:-1], n) < np.repeat(take, n)
    return n, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(take))).astype(np.int32)), pa.array(T.signed(d[keep])))


def frequent_runs(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> np.ndarray:
    """The runs that several texts of a sample hold, sorted.  They decide about order alone, so any sample gives the same pairs."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, o = T.word_hashes([masked(body_of(t)[2]) for t in b.column(0).to_pylist()])
            s, _ = T.distinct_by_text(*T.shingle_hashes(h, o, SHINGLE))
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(s))], names=["s"])

    some = docs.select(F.col(text).cast("string").alias("text")).where("text is not null").sample(0.05, 7).limit(sample)
    rows = some.mapInArrow(look, "s long").groupBy("s").count().where(F.col("count") >= FREQUENT).select("s").collect()
    return np.sort(np.array([r.s for r in rows], np.int64).view(np.uint64))


_MARKED = "doc_id long, label string, fp long, node long, part boolean, n_runs int, runs array<long>, n_words int, few array<long>"


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, trusted label, fingerprint, node = hash of the body's words in their order, numbers masked, part: has words, sizes and prefixes of its runs and, if few, words)."""
    frequent = frequent_runs(docs, text)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            labels, bodies = zip(*map(judged, texts)) if texts else ((), ())
            h, o = T.word_hashes([masked(t) for t in bodies])
            s, so = T.shingle_hashes(h, o, SHINGLE)
            n_runs, runs = prefixes(ordered(s, frequent), so, np.diff(o) >= 2 * SHINGLE)
            w, wo = T.distinct_by_text(h, o)
            n_words, few = prefixes(w, wo, np.diff(wo) <= SHORT_WORDS)
            place = (np.arange(len(h)) - np.repeat(o[:-1], np.diff(o))).astype(np.uint64)
            node = T.set_hashes(T.mix64(h + T.mix64(place)), o)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(labels, pa.string()), pa.array(T.signed(simhash(h, o))), pa.array(T.signed(node)), pa.array(np.diff(o) > 0),
                    pa.array(n_runs.astype(np.int32)), runs, pa.array(n_words.astype(np.int32)), few,
                ],
                names=[c.split()[0] for c in _MARKED.split(", ")],
            )

    base = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return base.where("text is not null").mapInArrow(look, _MARKED)


def similar(a: str, b: str) -> bool:
    """Jaccard similarity of the bodies' runs of five words (words in short texts), digits masked."""
    x, y = (T.words(masked(body_of(t)[2] or t)) for t in (a, b))
    k = SHINGLE if min(len(x), len(y)) >= 2 * SHINGLE else 1
    p, q = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (x, y))
    return bool(p or q) and len(p & q) >= SIMILARITY * len(p | q)


def residue(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hops: int | None = None) -> DataFrame:
    """(doc_id, label, hop): the documents that are residue; hop 0 is a trusted label, n a label that came over n links.  With hops, links beyond so many are not followed."""
    return spread(written(marked(docs, doc_id, text), "marked"), docs, doc_id, text, hops)


def spread(m: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hops: int | None = None) -> DataFrame:
    """The same from a table of marked(): trusted labels reach all near-copies of their documents, and the near-copies of these."""
    sure = m.where("label is not null").select("doc_id", "label", F.lit(0).alias("hop"))
    nodes = written(
        m.where("part").groupBy("node").agg(F.max(F.when(F.col("label") != "slot", F.col("label"))).alias("label"), F.min_by(F.struct("doc_id", "fp", "n_runs", "runs", "n_words", "few"), "doc_id").alias("x"))
        .select("node", "label", "x.*"),
        "nodes",
    )
    open_nodes = nodes.where("label is null")
    front = nodes.where("label is not null")
    found = written(front.select("node", "label", F.lit(1).alias("hop")), "found")
    hop = 0
    while hops is None or hop < hops:
        hop += 1
        if hop > MOST_HOPS:
            raise RuntimeError(f"labels still spread after {MOST_HOPS} hops")
        close = hamming_pairs(open_nodes, front)
        near = close.unionByName(_meeting(open_nodes, front)).groupBy("node", "doc_id", "fp", "doc_s").agg(F.min("label").alias("label"))
        near = written(near.join(small_side(found.select("node")), "node", "left_anti"), f"near{hop}")
        if near.isEmpty():
            break
        good = written(_verified(near, docs, doc_id, text), f"hop{hop}")
        if good.isEmpty():
            break
        found = written(found.unionByName(good.select("node", "label", F.lit(hop).alias("hop"))), f"found{hop}")
        front = nodes.drop("label").join(small_side(good.select("node", "label")), "node")
    members = m.where("label is null").join(small_side(found).withColumnRenamed("label", "l"), "node")
    sure = sure.unionByName(members.select("doc_id", F.col("l").alias("label"), "hop"))
    return sure.groupBy("doc_id").agg(F.min_by("label", F.struct("hop", "label")).alias("label"), F.min("hop").alias("hop"))


def hamming_pairs(nodes: DataFrame, front: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(node, doc_id, fp, doc_s, label): nodes and labelled nodes that share a key of a table and differ in at most `distance` bits."""
    seeds = written(front.select(F.col("fp").alias("fp_s"), F.col("doc_id").alias("doc_s"), "label", F.explode(tables_of(F.col("fp"))).alias("k")).select("fp_s", "doc_s", "label", "k.*"), "tables")
    keyed = nodes.select("node", "doc_id", "fp", F.explode(tables_of(F.col("fp"))).alias("key")).select("node", "doc_id", "fp", F.col("key.t").alias("t"), F.col("key.k").alias("k"))
    met = keyed.join(F.broadcast(seeds), ["t", "k"]) if is_small(seeds) else spread_join(seeds, keyed, ["t", "k"])
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_s"))) <= distance).select("node", "doc_id", "fp", "doc_s", "label")


def _meeting(nodes: DataFrame, front: DataFrame) -> DataFrame:
    """(node, doc_id, fp, doc_s, label): every node and labelled node whose prefixes meet and whose sizes allow for similarity SIMILARITY."""

    def keys(df: DataFrame, *cols: Column) -> DataFrame:
        runs = df.select(*cols, F.lit(True).alias("run"), F.col("n_runs").alias("n"), F.explode("runs").alias("key"))
        return runs.unionByName(df.select(*cols, F.lit(False).alias("run"), F.col("n_words").alias("n"), F.explode("few").alias("key")))

    seeds = written(keys(front, F.col("doc_id").alias("doc_s"), F.col("label")).withColumnRenamed("n", "n_s"), "prefixes")
    mine = keys(nodes, F.col("node"), F.col("doc_id"), F.col("fp"))
    met = mine.join(F.broadcast(seeds), ["run", "key"]) if is_small(seeds) else spread_join(seeds, mine, ["run", "key"])
    least = SIMILARITY - 1e-9
    return met.where((F.col("n") >= least * F.col("n_s")) & (F.col("n_s") >= least * F.col("n"))).select("node", "doc_id", "fp", "doc_s", "label")


def _verified(near: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The candidates whose text is similar to that of a labelled document."""
    wanted = written(near.select(F.explode(F.array("doc_id", "doc_s")).alias("id")).distinct(), "wanted")
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(small_side(wanted), "id", "left_semi")
    texts = written(texts.groupBy("id").agg(F.max("text").alias("text")), "texts")
    both = near.join(texts.withColumnsRenamed({"id": "doc_id", "text": "a"}), "doc_id").join(texts.withColumnsRenamed({"id": "doc_s", "text": "b"}), "doc_s")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(mask) for i in range(4)], names=["node", "doc_id", "fp", "label"])

    out = both.select("node", "doc_id", "fp", "label", "a", "b").mapInArrow(check, "node long, doc_id long, fp long, label string")
    return out.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), F.min("label").alias("label"))
