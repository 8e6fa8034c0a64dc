"""Broken prompt and response pairs (problem 1).

Method: ordered rules for emptiness, unclosed delimiters and abrupt endings
(the judge of millrace.llm.truncation, shared with problem 5), multilingual
refusal phrases, copied prefixes, and a mismatch of script or language.  Every
triggered defect type is emitted, in the order of ORDER; the first one is the
pair's defect.

A defect excludes those that make no sense beside it: an empty response has no
other defect, a refusal has no wrong language.

Nulls: a null or blank response is `empty`; a null prompt can be neither copied
nor compared in language.  A null rollout_id gives no row.  Deliveries of one
rollout_id count once (their defects are united).  Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import tokens as T
from millrace.llm.truncation import evidence, judged
from millrace.session import written

ORDER = ["empty", "truncated", "refusal", "copy", "language"]

#: Signs for "no value".
NO_VALUE = {"null", "none", "nil", "nan", "n/a", "na", "n.a", "undefined", "empty", "void", "no answer", "no response", "keine", "kein", "aucun", "ninguno", "ninguna", "nada", "leer", "vide", "vacío", "无", "空", "-", "--", "[]", "{}", "()"}

_MARKUP = re.compile(r"</?[A-Za-z][\w-]*\s*/?>|```\w*|\\boxed\{\s*\}|\\[()\[\]]|\$\$?")
_THINK = re.compile(r"<think>.*?(?:</think>|\Z)", re.S)
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_INVISIBLE = re.compile("[\\s\u00ad\u200b-\u200f\u2028-\u202f\u2060\ufeff]+")
_QUOTES = "\"“«„「`"
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“]*“|「[^」]*」|`[^`]*`")


#: More words in a row than any sign for "no value" or tag has: the text is not empty.
_CONTENT = re.compile(r"[^\W_]+ [^\W_]+ [^\W_]+|[㐀-鿿]{4}")


def is_empty(text: str | None) -> bool:
    """No content once blanks and markup are set aside, or only a sign for no value."""
    if text is None:
        return True
    if _CONTENT.search(text):
        return False
    bare = _INVISIBLE.sub(" ", _MARKUP.sub(" ", text)).strip()
    if not any(c.isalnum() for c in bare):
        return not re.search(r"[=<>+*/^∞√∅π]", bare)
    return bare.strip(" .*_\"'!()[]<>").lower() in NO_VALUE


#: Phrases by which a speaker declines, by language.
_DECLINE = re.compile(
    r"""
    \b(?:i|we)(?:\ (?:must|have\ to|am|are|do|will|would|can|could|'d|'m)|'m|'d|'ve)?\b[^.!?]{0,24}?
        \b(?:can\ ?not|can'?t|can’t|won'?t|won’t|will\ not|shall\ not|do\ not|don't|must\ not|may\ not|unable|not\ able|not\ permitted|not\ allowed|not\ in\ a\ position|
           in\ no\ position|no\ position|refuse|decline|rather\ not|prefer\ not|not\ feel\ free|have\ to\ pass|decided\ not|not\ comfortable|not\ authori[sz]ed|not\ going\ to)\b
    | \b(?:have|has)\ to\ (?:decline|refuse|pass)\b | \bsomething\ i\ (?:have\ to|must|will)\ (?:decline|refuse)
    | \bguidelines?\b[^.!?]{0,30}\b(?:keep|prevent|forbid|stop|prohibit|not\ allow) | \boutside\ what\ i\b | \bnot\ be\ appropriate\b | \bagainst\ my\b
    | \bno\ image\ reached\ me\b | \bbeyond\ (?:my|what\ i) | \b(?:is|are)\ off[-\ ]limits\b | \bnot\ something\ i\ (?:can|will|may)\b
    | \b(?:kann|darf|möchte|werde|will)\b[^.!?]{0,40}\b(?:nicht|keine?n?)\b | \bnicht\ (?:helfen|beantworten|bearbeiten|möglich|in\ der\ lage) | \b(?:muss|möchte)\ (?:ich\ )?(?:\w+\ ){0,4}ablehnen
    | \bne\ (?:peux|veux|puis|suis|souhaite|dois|saurais)\b[^.!?]{0,30}\b(?:pas|point)\b | \bpréfère\ ne\ pas\b | \bm'est\ impossible\b | \bm’est\ impossible\b | \b(?:refuse|décline)\b | \bdois\ (?:refuser|décliner)
    | \bno\ (?:puedo|me\ está\ permitido|me\ es\ posible|estoy\ autorizad[oa]|voy\ a|quiero)\b | \bprefiero\ no\b | \b(?:debo|tengo\ que)\ (?:rechazar|negarme|declinar)\b | \bme\ niego\b
    | \bnon\ (?:posso|possiamo|sono\ in\ grado|mi\ è\ (?:possibile|permesso))\b | \b(?:devo|dobbiamo)\ (?:rifiutare|declinare)\b | \bpreferisco\ non\b
    | \bnão\ (?:posso|podemos|consigo|estou\ autorizad[oa]|me\ é\ permitido)\b | \b(?:devo|tenho\ de|tenho\ que)\ recusar\b | \bprefiro\ não\b
    | \b(?:kan|mag|wil)\b[^.!?]{0,40}\bniet\b | \bmoet\b[^.!?]{0,40}\bweigeren\b
    | \bне\ (?:могу|можем|в\ состоянии)\b | できません | 致しかねます | 할\ 수\ 없
    | 无法 | 不能 | 不便 | 拒绝 | 不可以 | 没有办法 | 不予
    """,
    re.X | re.I,
)
#: Words that speak of the request itself or of the speaker's role or regret.
_ABOUT = re.compile(
    r"""
    \b(?:this|that|your|the|these|those|such)\ (?:question|request|problem|task|topic|query|matter|figure)s?\b | \bquestions?\ of\ this\ kind\b | \btask\ you\ describe\b | \bfigure\ you\ mention\b
    | \bthis\b | \bthat\b | \bhelp\b | \bassist(?:ant)?\b | \bsorry\b | \bapolog | \bunfortunately\b | \bguidelines?\b | \brephrase\b | \banother\ question\b | \bspecialist\b | \bhonest\b
    | \b(?:frage|aufgabe|anfrage|bitte|dazu|dabei|auskunft|helfen|leid|leider|assistent)\b
    | \b(?:question|demande|aider|point|désolée?|malheureusement|assistante?|sujet)\b
    | \b(?:pregunta|tarea|ayudar|eso|lo\ siento|desgracia|lamentablemente|asistente|solicitud|tema)\b
    | \b(?:richiesta|domanda|compito|aiutar\w*|dispiace|purtroppo|assistente|argomento)\b | \b(?:pergunta|pedido|tarefa|ajudar|desculpe|infelizmente|solicitação)\b | \b(?:vraag|verzoek|opdracht|helpen|helaas|spijt)\b
    | \b(?:вопрос\w*|запрос\w*|помочь|сожалению)\b | 質問 | お答え | 申し訳 | 질문 | 죄송
    | 问题 | 请求 | 任务 | 抱歉 | 遗憾 | 助手 | 帮助 | 回答
    """,
    re.X | re.I,
)
#: What an answer is marked by, and what may be one.
_MARKED = re.compile(r"\\boxed\{[^{}]*\S[^{}]*\}|####\s*\S|\*\*\s*-?\d|```\w*\s*\S")
_ANSWER = re.compile(_MARKED.pattern + r"|(?<![\w])-?\d")
#: The request itself, without mere pointing words.
_REQUEST_ITSELF = re.compile(
    r"\b(?:this|that|your|the|these|those|such)\ (?:question|request|problem|task|topic|query|matter)s?\b|\byour\ (?:\w+\ )?request|\b(?:question|request|topic|task|problem|matter)s?\ (?:of|like)\ (?:this|that)\b|\b(?:help|assist|respond|comply)\b|(?<!the )\banswer\b(?! is)|\b(?:language\ model|assistant|sorry|apologi[sz]e|unfortunately)\b"
    r"|\b(?:anfrage|frage|aufgabe|helfen|beantworten|leider|assistent|demande|aider|répondre|malheureusement|assistante?|solicitud|pregunta|ayudar|responder|lamentablemente|asistente|richiesta|domanda|aiutar\w*|rispondere|purtroppo|pergunta|pedido|ajudar|infelizmente|verzoek|vraag|helpen|helaas)\b"
    r"|请求|问题|帮助|回答|抱歉",
    re.I,
)
_SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")


def without_thought(text: str) -> str:
    return _THINK.sub(" ", text) if "<think>" in text else text


def is_refusal(text: str) -> bool:
    """Declines and gives no answer: no marked answer, and no number or code outside quotations and the sentences that decline.

    Either one of the first two sentences declines the request itself, whatever is said then, or most of the text declines
    or speaks of the request.
    """
    body = without_thought(text)
    body = body if body.strip() else text
    if any(c in body for c in _QUOTES):
        body = _QUOTED.sub(" ", body)
    *opening, rest = (_SENTENCES.split(body.strip(), 2) + [""])[:3]
    if _ANSWER.search(rest) or _MARKED.search(body):
        return False
    numbered = any(_ANSWER.search(s) for s in opening)
    declines = [_DECLINE.search(s) is not None for s in opening]
    if numbered and any(_ANSWER.search(s) for s, d in zip(opening, declines) if not d):
        return False
    if any(d and _REQUEST_ITSELF.search(s) for s, d in zip(opening, declines)):
        return True
    if numbered or not _DECLINE.search(body) or not _ABOUT.search(body):
        return False
    sentences = [s for s in _SENTENCES.split(body) if s.strip()]
    of_it = sum(len(s) for s in sentences if _ABOUT.search(s) or _DECLINE.search(s))
    return 2 * of_it >= sum(map(len, sentences))


COPY_WINDOW = 12
#: Characters at the end that are looked at first.
LOOK = 400
#: Characters in which the last word is looked for.
LAST = 60
COPY_COVER = 0.7
COPY_EXTRA = 0.04
#: Words that may lead in a copy ("You asked: ...").
COPY_LEAD = 5


def ends_otherwise(prompt: str, text: str) -> bool:
    """Whether the last word of a text is surely none of the prompt's: a copy ends with one.  Told for plain texts only."""
    end = text[-LAST:]
    if "&" in end or "<" in end or "&" in prompt or not (end.isascii() and prompt.isascii()):
        return False
    words = T.WORD.findall(end.lower())
    return len(words) > 1 and words[-1] not in prompt.lower()


def is_copy(prompt: str, text: str) -> bool:
    """Gives back the prompt, whole or nearly so, once or again and again, and nothing else."""
    if ends_otherwise(prompt, text):
        return False
    p, known = prompt_words(prompt)
    if len(p) < 4:
        return False
    if len(text) > LOOK:
        # the words of the end that the prompt does not have are already more than a copy of any length this text can have may hold
        end = text[-LOOK:]
        end = T.words(T.strip_markup(end[end.find(" ") + 1 :]))[1:]
        most = len(text) // 2 + 1 if text.isascii() else len(text)
        if len(end) - sum(map(known.__contains__, end)) > max(1, COPY_EXTRA * most) + COPY_LEAD:
            return False
    r = T.words(T.strip_markup(text))
    if len(r) < COPY_COVER * len(p) or len(r) - sum(map(known.__contains__, r)) > max(1, COPY_EXTRA * len(r)) + COPY_LEAD:
        return False
    lead = next((i for i, w in enumerate(r[: COPY_LEAD + 1]) if w in p[:3]), 0)
    r = r[lead:]
    extra = matched = j = hits = 0
    last_extra = False
    for w in r:
        k = next((x for x in range(j, min(len(p), j + COPY_WINDOW)) if p[x] == w), -1)
        if k < 0 and j >= 0.85 * len(p):
            k = next((x for x in range(min(len(p), COPY_WINDOW // 2)) if p[x] == w), -1)
            if k >= 0:
                if hits < COPY_COVER * len(p):
                    return False
                hits = 0
        last_extra = k < 0
        if last_extra:
            extra += 1
        else:
            matched += 1
            hits += 1
            j = k + 1
    if last_extra or hits < COPY_COVER * len(p):
        return False
    return extra <= max(1, COPY_EXTRA * len(r)) and matched >= COPY_COVER * len(p)


@lru_cache(maxsize=20_000)
def prompt_words(prompt: str) -> tuple[list[str], frozenset[str]]:
    """(words, their set)."""
    p = T.words(T.strip_markup(prompt))
    return p, frozenset(p)


#: Frequent words that tell the Latin-script languages apart (fixed values).
STOPWORDS = {
    "en": "hours minutes seconds metres pages steps per across beyond above into over their out the of and a an in is its it with near through behind under has every most what which how many so that as soon for this not are was were by from when while although because whenever until both neither nor only than yet beside within against you your to be at on we get answer",
    "de": "stunden minuten meter seiten schritte liter selten langsam meist rasch oft genau drehte der die das und ein eine einen einem einer mit von bei in im aus nach über gibt es aber wie hat ist nicht folgt zwischen zu den dem des auf für wer kennt sie sich noch mehr als wenn wird sind also bleibt man durch zuerst dort kaum keine kein pro welche viele lautet ich sobald während",
    "fr": "parce encore souvent parfois presque enfin rarement vite heures minutes mètres pages étapes le la les de des du et un une à en que qui dans par plus il elle est vaut quelle quel selon après entre sur ne pas pour au aux avec sa son ses près chaque aucune aucun puis donc on obtient reste combien réponse je nous vous ce cette dès alors quand",
    "es": "casi apenas siempre pronto horas minutos metros páginas junto despacio pasos litros el la los las de del y un una en que por más es hay quedan según tras entre junto con cerca se su sus al para no lo como otra otro luego cada ninguna ninguno primero qué tiene cuántas cuántos después queda respuesta mide porque aunque mientras sale dividir pero solo aún todavía",
    "pt": "o os as um uma e do da dos das em no na nos nas que não por mais com para é são como seu sua depois entre cada nenhum porque quando então ao pelo pela",
    "it": "il lo gli di del della dei delle e un una in nel nella che non per più con è sono come dopo tra ogni nessuno perché quando allora al alla si ma anche",
    "nl": "de het een en van in op met voor niet is zijn dat die door als bij aan uit naar maar ook wordt hoeveel geen over tussen",
}
_STOP: dict[str, list[str]] = {}
for _k, _v in STOPWORDS.items():
    for _w in set(_v.split()):
        _STOP.setdefault(_w, []).append(_k)
#: Letters that point to a language, with how many words each is worth.
_LETTERS = [("es", re.compile(r"[ñ¿¡]|\w[áíóú]\w*", re.I), 0.7), ("de", re.compile(r"[äöüß]", re.I), 0.7), ("fr", re.compile(r"[èêëàâçœîôûù]|\b[ldnsjcqm]['’]\w|é\w*\b", re.I), 0.5), ("pt", re.compile(r"[ãõ]", re.I), 0.8)]
_SCRIPTS = [
    ("zh", re.compile(r"[㐀-䶿一-鿿]")), ("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힯]")), ("ru", re.compile(r"[Ѐ-ӿ]")),
    ("ar", re.compile(r"[؀-ۿ]")), ("he", re.compile(r"[֐-׿]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("el", re.compile(r"[Ͱ-Ͽ]")), ("th", re.compile(r"[฀-๿]")),
]
LEAST_PROSE = 4
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]+")
_FORMULA = re.compile(r"\$[^$]*\$|\\[a-zA-Z]+(?:\{[^{}]*\})*")
_VALUE = re.compile(r"\s*[\w.]+")


def without_formulas(text: str) -> str:
    """The text without formulas, commands and assignments (`x = 3`)."""
    if "$" in text or "\\" in text:
        text = _FORMULA.sub(" ", text)
    if "=" not in text:
        return text
    left, *rest = text.split("=")
    out = []
    for right in rest:
        word = left.rstrip()
        k = len(word)
        while k and (word[k - 1].isalnum() or word[k - 1] == "_"):
            k -= 1
        value = _VALUE.match(right)
        if k < len(word) and value:
            out.append(word[:k])
            left = " " + right[value.end() :]
        else:
            out.append(left + "=")
            left = right
    return "".join(out) + left



def language_of(text: str) -> str | None:
    """The language of a prose text; null if there is too little prose to tell."""
    if "`" in text:
        text = _FENCE.sub(" ", text)
    if "<" in text or "\\" in text or "$" in text or "=" in text:
        text = without_formulas(_MARKUP.sub(" ", text))
    ascii_only = text.isascii()
    latin = _LATIN.findall(text.lower())
    if not ascii_only:
        counts = {name: len(p.findall(text)) for name, p in _SCRIPTS if p.search(text)}
        if counts.get("ja"):
            counts["ja"] += counts.get("zh", 0)
        name = max(counts, key=lambda k: counts[k], default=None)
        if name and counts[name] >= LEAST_PROSE and counts[name] > 2 * len(latin):
            return name
    if len(latin) < LEAST_PROSE:
        return None
    score: Counter = Counter()
    for known in filter(None, map(_STOP.get, latin)):
        for k in known:
            score[k] += 1
    if not ascii_only:
        for k, p, worth in _LETTERS:
            score[k] += worth * min(6, len(p.findall(text)))
    (best, top), *rest = score.most_common(2) or [("", 0)]
    second = rest[0][1] if rest else 0
    return best if top >= 1.5 and top - second >= 0.25 * top else None


#: Names of languages as they stand in requests (fixed values).
LANGUAGE_NAMES = {
    "en": "english|englisch\\w*|anglais|inglés|ingles|英语|英文", "de": "german|deutsch\\w*|allemand|alemán|德语|德文", "fr": "french|französisch\\w*|français|francés|法语|法文",
    "es": "spanish|spanisch\\w*|espagnol|español|castellano|西班牙语|西班牙文", "zh": "chinese|mandarin|chinesisch\\w*|chinois|chino|中文|汉语|简体中文", "pt": "portuguese|portugiesisch|portugais|portugués|葡萄牙语",
    "it": "italian|italienisch|italien|italiano|意大利语", "ja": "japanese|japanisch|japonais|japonés|日语|日文", "ru": "russian|russisch|russe|ruso|俄语|俄文", "nl": "dutch|niederländisch|néerlandais|neerlandés|荷兰语",
    "ko": "korean|koreanisch|coréen|coreano|韩语", "ar": "arabic|arabisch|arabe|árabe|阿拉伯语",
}
_REQUEST = re.compile(
    r"(?:repl(?:y|ies)|answers?|respon\w+|writ\w+|language|speak|antwort\w*|schreib\w*|sprache|répon\w+|écri\w+|langue|respuesta|escrib\w*|idioma|contest\w*|回答|答复|回复|作答|用|以|translate\w*|auf|in|en)"
    r"[^.?!\n。？！]{0,40}?(?:" + "|".join(f"(?P<{k}>{v})" for k, v in LANGUAGE_NAMES.items()) + r")(?!\w)",
    re.I,
)
_REQUEST_SENTENCE = re.compile(r"\([^()]*\)|[^.?!。？！()\n]*[.?!。？！]?")


#: In lower case, a part of every text in which _REQUEST finds a language.
_NAME_SIGNS = tuple({re.sub(r"\\w\*$", "", n) for v in LANGUAGE_NAMES.values() for n in v.split("|")})


def _names_a_language(prompt: str) -> bool:
    low = prompt.lower()
    return any(n in low for n in _NAME_SIGNS)


def asked_languages(prompt: str) -> set[str]:
    """The languages a prompt asks the reply to be in."""
    return {k for m in _REQUEST.finditer(prompt) for k, v in m.groupdict().items() if v}


def without_requests(prompt: str) -> str:
    """The prompt without the sentences that ask for a language."""
    return "".join(m.group() for m in _REQUEST_SENTENCE.finditer(prompt) if not _REQUEST.search(m.group()))


def after_restating(prompt: str, text: str) -> str:
    """The response without the prompt it restates at its beginning."""
    p, n = prompt.strip(), len(prompt.strip())
    t = text.lstrip()
    if n and t[:n].lower() == p.lower():
        return t[n:]
    head = re.match(r"\W*", t).end()
    if n and t[head : head + n].lower() == p.lower():
        return t[head + n :]
    return text


@lru_cache(maxsize=20_000)
def prompt_languages(prompt: str) -> tuple[str | None, frozenset[str]]:
    """(the prompt's own language, the languages it asks for)."""
    if not _names_a_language(prompt):  # then no request is found
        return language_of(prompt), frozenset()
    return language_of(without_requests(prompt)) or language_of(prompt), frozenset(asked_languages(prompt))


def is_other_language(prompt: str, text: str) -> bool:
    """Prose in a language that is neither the prompt's nor one it asks for."""
    own, asked = prompt_languages(prompt)
    if own is None:
        return False
    rest = after_restating(prompt, text)
    body = without_thought(rest)
    said = language_of(body)
    if said is None:
        thought = " ".join(m.group() for m in _THINK.finditer(rest))
        said = language_of(thought) if len(_LATIN.findall(_FENCE.sub(" ", without_formulas(body)))) < 2 * LEAST_PROSE else None
    return said is not None and said != own and said not in asked


def rules(prompt: str | None, text: str | None) -> list[str]:
    """Every defect of a pair but truncation, which needs the corpus."""
    if is_empty(text):
        return ["empty"]
    out = []
    if is_refusal(text):
        out.append("refusal")
    if prompt and is_copy(prompt, text):
        out.append("copy")
    if prompt and "refusal" not in out and is_other_language(prompt, text):
        out.append("language")
    return out


def broken_pairs(
    df: DataFrame, row_id: str = "rollout_id", prompt: str = "prompts", response: str = "responses", group: str = "data_source"
) -> DataFrame:
    """(rollout_id, defects, defect): the defective pairs with all defects and the first one."""

    ev = written(evidence(df, "responses", row_id, response, group, prompt, rules), "evidence")
    plain = ev.where("kind = 'v' and size(found) > 0").select("id", F.col("found").alias("defects"))
    cut = judged(ev, df, row_id, response).where("cut").select("id", F.array(F.lit("truncated")).alias("defects"))
    every = plain.unionByName(cut).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("defects"))).alias("d"))
    order = F.array(*[F.lit(x) for x in ORDER])
    defects = F.array_intersect(order, "d")
    # an empty response has no other defect; refusals are never also language
    defects = F.when(F.array_contains("d", "empty"), F.array(F.lit("empty"))).when(F.array_contains("d", "refusal"), F.array_except(defects, F.array(F.lit("language")))).otherwise(defects)
    return every.select(F.col("id").alias("rollout_id"), defects.alias("defects")).withColumn("defect", F.element_at("defects", 1))


def defect_rates(pairs: DataFrame, df: DataFrame, row_id: str = "rollout_id", group: str = "data_source") -> DataFrame:
    """(data_source, defect, n_pairs, n_defect): every triggered type by source."""
    rows = df.where(F.col(row_id).isNotNull()).groupBy(F.col(row_id).cast("long").alias("rollout_id")).agg(F.min(group).alias("data_source"))
    hits = rows.join(pairs, "rollout_id", "left")
    n = hits.groupBy("data_source").agg(F.count("*").alias("n_pairs"))
    by = hits.select("data_source", F.explode("defects").alias("defect")).groupBy("data_source", "defect").agg(F.count("*").alias("n_defect"))
    return by.withColumnRenamed("data_source", "s").join(n, F.col("s").eqNullSafe(F.col("data_source"))).select("data_source", "defect", "n_pairs", "n_defect")
