"""General cues and usual wordings of site messages, placeholders and filler: the weak labels of problem 4.

Nothing here decides on a row. ``CUE`` and the other patterns label segments of the training sample; ``seeds``
are further training examples: the reason phrases of the HTTP statuses and common wordings of notices in
the languages of the board, put together from short lists.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from http import HTTPStatus
from itertools import product

_THING = r"(?:pages?|adverts?|ads?|posting|postings|jobs?|vacanc(?:y|ies)|positions?|listings?|offers?|openings?|content|url|link)"
# Cues of a response status or of a site that speaks to its visitor.
CUES = [
    # statuses and failures
    r"\b[45]\d\d\b\W{0,3}(?:-|:|–)?\s*(?:the page|error|bad gateway|not found|forbidden|internal server|service unavailable|gateway|unauthori[sz]ed|too many)", r"\b(?:http|error|erreur|fehler|código|錯誤代碼|错误代码|status)\W{0,2}(?:code\W{0,2})?[45]\d\d\b", r"\bbad gateway\b",
    r"\bgateway time-?out\b", r"\bupstream (?:server|connect)", r"\bno valid answer\b", r"\binternal server error\b", r"\bservice (?:is )?(?:temporarily )?unavailable\b", r"\bservice est (?:momentanément )?indisponible\b", r"\btoo many requests\b", r"\brequest(?:s)? (?:was |were )?(?:blocked|denied)\b",
    r"\baccess (?:is |was )?denied\b", r"\b(?:you )?do not have permission to\b", r"\bsomething went wrong\b", r"\bunexpected error\b", r"\bengineers have been (?:told|notified|informed)\b", r"\bconnection (?:to .{1,60})?timed out\b", r"\berror establishing\b", r"\btraceback\b.{0,60}\bline \d+", r"\bkeyerror\b",
    r"\b(?:doing|under|scheduled) maintenance\b", r"\btry again (?:in \d+|later|in a few)\b", r"\bwait \d+ (?:minutes|seconds)\b", r"\breload (?:the|this) page\b",
    # gone
    rf"\b{_THING}\b.{{0,60}}\b(?:could not be found|cannot be found|not found|does not exist|no longer (?:available|open|active|online|exists)|has been (?:removed|deleted|taken down|filled|closed)|has expired|was removed)\b", r"\bmay have been (?:moved|removed|deleted)\b", r"\bseite wurde nicht gefunden\b",
    r"\bpágina no (?:disponible|encontrada|existe)\b", r"\bvuelva al inicio\b", r"\bpage introuvable\b", r"\bveuillez revenir plus tard\b", r"(?:頁面|页面|職位|网页|網頁).{0,8}(?:不存在|已被移除|已移除|已下架|找不到)",
    # checks and log-in
    r"\b(?:not a robot|captcha|checking (?:that|if|your browser)|verify (?:that )?you are)\b", r"\bthis can take a few seconds\b", r"\bsession (?:has |is )?(?:expired|timed out|ended)\b", r"^\W*(?:please )?(?:log|sign) ?in\b.{0,60}$", r"\b(?:log|sign) in (?:again )?to (?:see|view|read|go on|continue|apply)\b", r"^\W*forgot (?:your )?password\W*",
    r"^\W*(?:join now|register now|new here)\W*$", r"\bnew here\W+join now\b",
    # scripts and browsers
    r"\b(?:enable|activate|allow|turn on|switch on|activer|activez|aktivieren sie|active|activa)\b.{0,20}\b(?:javascript|scripts|cookies)\b", r"(?:啟用|启用|開啟|开启) ?(?:javascript|cookie)", r"\b(?:javascript|scripts|cookies)\b.{0,30}\b(?:turned off|disabled|switched on|blocked|required to view|are needed|is needed)\b",
    r"\bscripts may be blocked\b", r"\bbrowser is (?:not supported|out of date|outdated)\b", r"^\W*loading\b.{0,30}\.{2,}", r"^\W*loading (?:job )?details\b",
    # texts to be written
    r"\b(?:sample|dummy|placeholder|example) (?:job )?(?:description|text|content)\b", r"\breplace (?:this )?(?:text )?before publishing\b", r"\bplaceholder text\b", r"\b(?:more text|description|text|details) (?:to follow|folgt|coming soon|goes here)\b", r"^\W*(?:to be (?:confirmed|advised|announced)|tbc|tba|tbd|coming soon|dummy|todo)\W*$",
    r"^\W*\[?todo\b", r"(?:此處|此处|在此)(?:填寫|填写|輸入|输入)", r"\benter (?:a|the|your) (?:job )?description\b", r"\bused for checking the form\b", r"\bplease ignore\b", r"\bx{4,}\b",
]
CUE = re.compile("|".join(CUES))
# Words of which every cue in Latin letters has one, to skip the patterns on most segments.
_HINTS = frozenset(
    "page pages error gateway forbidden internal unauthorized unauthorised many http erreur fehler código status upstream answer server service requests request denied permission wrong engineers connection establishing traceback keyerror maintenance again wait found exist exists longer "
    "removed deleted down filled closed expired moved seite página vuelva revenir robot captcha checking verify seconds session log login sign forgot join register new javascript scripts cookies browser loading description text content publishing follow folgt soon confirmed advised announced "
    "tbc tba tbd dummy todo form ignore xxxx xxxxx xxxxxx".split()
)
# Words that show that a sentence tells of work with such things.
TALK = re.compile(
    r"\b(?:such as|called|experience|you will|you have|explains?|documented|handled|required for this|responsib\w+|our (?:shop|team|colleagues|clients|customers|engineers (?!have been))|by half|each (?:week|month|catalogue)|hours:|knowledge of|style(?:\s+sheets?)?|syntax)\b|\bin a \S+ ?\S* ?style"
)
SPOKEN_OF_BEFORE = re.compile(r"(?:such as|called|named|like)\s*$")
SPOKEN_OF_AFTER = re.compile(r"\s*(?:style|syntax|format|language|notation)")
# Usual names of the fields of a template and words that ask to fill something in.
_FIELDS = frozenset("company employer firm team manager branch department city location address salary benefit benefits duties task tasks industry product count headcount years title position role name date phone email reference skill start month employment_type workplace hours".split())
_ASKS = re.compile(r"\b(?:insert|enter|add|fill in|your|here|todo|tbc|tbd|placeholder|dummy|xxx?|einsetzen|einfügen|ajouter|insérer|insertar)\b|請填寫|请填写|填寫|_|^(?:[a-z]+ )?(?:name|title|date|number|address|range)$|^[a-z]{1,3}\d$")
# The common filler passage, by its public wording.
_PASSAGE = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
_STEMS = tuple(sorted({w[:4] for w in _PASSAGE.split() if len(w) > 3} | {"sint", "elit", "anim"}))
_FILLER = re.compile(rf"\b(?:{'|'.join(_STEMS)})")
_STRUCK = re.compile(rf"\b(?:{'|'.join(sorted({r[i : i + 4] for r in ('qwertyuiop', 'asdfghjkl', 'zxcvbnm', 'qwertzuiop') for i in range(len(r) - 3)}))})")


def is_field(words: str) -> bool:
    """Whether the inside of a bracket names a field of a template or asks to fill something in."""
    parts = re.findall(r"[^\W\d_]+", words)
    return bool(_ASKS.search(words)) or 0 < len(parts) <= 3 and any(p in _FIELDS for p in parts)


def is_filler(segment: str, words: list[str]) -> bool:
    """Words of the filler passage (whatever their endings), keys struck in a row, or few words over and over."""
    n = len(words)
    if n < 3:
        return False
    return n >= 4 and (len(_FILLER.findall(segment)) >= 0.5 * n or len(set(words)) <= n // 3) or len(_STRUCK.findall(segment)) >= 0.5 * n


def has_cue(segment: str, words: list[str]) -> bool:
    """Whether a case-folded segment shows a cue of a notice."""
    return (not _HINTS.isdisjoint(words) or not segment.isascii()) and CUE.search(segment) is not None


# Wordings of notices by parts, in the languages of the board.
_NOUNS = "job|vacancy|position|advert|posting|listing|page|job offer".split("|")
_GONE = "is no longer available|has been removed|has expired|is no longer accepting applications|has been closed|could not be found|does not exist any more|has been filled|was deleted|is not available in your region".split("|")
_ENTRY = "log in|sign in|create an account|register".split("|")
_TO = "to continue|to view this job|to see the full advert|to read the description|to apply".split("|")
_SWITCH = "enable|turn on|activate|allow".split("|")
_PARTS = "javascript|cookies|scripts|javascript and cookies".split("|")
_SINGLE = {
    "en": "verify that you are human|verify you are not a robot|prove that you are not a robot to go on|you need an account to read this|create a free account to see this posting|the browser blocked this content|please confirm that you are not a robot|are you a robot|complete the captcha to continue|checking your browser before accessing the site|please wait while we check your connection|unusual traffic from your network|your request has been blocked|you have been blocked|your ip address has been blocked|"
    "your browser is out of date|please update your browser|this site requires javascript|you must be logged in|please log in first|your session has ended|session timed out, please sign in again|we could not load this page|an error occurred while loading the page|oops, something went wrong|sorry, an unexpected error occurred|please try again later|"
    "the server is busy|the site is down for maintenance|we will be back soon|this content is not available|sorry, this page is not available|the link you followed may be broken|return to the home page|go back to the search results|loading, please wait|please wait|description will be added soon|job description goes here|write the job description here|"
    "insert text here|add the description here|text to be added|content coming soon|placeholder text|placeholder|todo|to do: write the advert|[todo] describe the role|lorem ipsum|example text, please replace|this is a test advert, please ignore|test posting do not apply|no description|description not available|delete this line before publishing",
    "de": "bitte loggen sie sich ein|melden sie sich an, um diese anzeige zu sehen|bitte melden sie sich an|diese stelle ist nicht mehr verfügbar|diese anzeige wurde entfernt|die stellenanzeige ist abgelaufen|seite nicht gefunden|die seite existiert nicht mehr|zugriff verweigert|bitte aktivieren sie javascript|bitte aktivieren sie cookies|"
    "ihre sitzung ist abgelaufen|bestätigen sie, dass sie kein roboter sind|es ist ein fehler aufgetreten|bitte versuchen sie es später erneut|der dienst ist zurzeit nicht verfügbar|wird geladen|platzhalter|hier text einfügen|beschreibung folgt|text folgt|mustertext, bitte ersetzen",
    "fr": "veuillez vous connecter|connectez-vous pour voir cette offre|cette offre n'est plus disponible|cette annonce a expiré|page introuvable|page non trouvée|accès refusé|veuillez activer javascript|activez les cookies de votre navigateur|votre session a expiré|confirmez que vous n'êtes pas un robot|une erreur est survenue|veuillez réessayer plus tard|"
    "service indisponible|chargement en cours|texte à venir|insérer le texte ici|description à compléter",
    "es": "inicie sesión para continuar|inicia sesión para ver esta oferta|esta oferta ya no está disponible|la oferta ha caducado|página no encontrada|acceso denegado|active javascript en su navegador|active las cookies|su sesión ha caducado|confirme que no es un robot|se ha producido un error|inténtelo de nuevo más tarde|servicio no disponible|cargando|"
    "texto de ejemplo|inserte el texto aquí|descripción pendiente",
    "zh": "請先登入|请先登录|需要登入才能查看此職位|需要登录才能查看|登入後即可查看|此職位已下架|该职位已下线|此頁面不存在|找不到頁面|页面不存在|存取被拒|请启用javascript|請啟用cookie|連線逾時|您的登入已過期|请完成验证|請確認您不是機器人|系統繁忙，請稍後再試|服務暫停|載入中|正在加载|此處填寫內容|请在此输入职位描述|內容待補",
}
# Sentences of adverts that speak of such things.
_TEXT = (
    "you will bring down the number of 404 pages and failed requests|you will write error messages that visitors understand|experience with javascript and cookies is required|javascript is required for this post|you will log in to our ticket system every morning|you test the sign in page of our shop|"
    "you keep the site up during maintenance|our service is available day and night|you fill in forms and enter orders|you replace templates such as letters before publishing|knowledge of access rights and permissions|the position is open to everybody|we have removed a level of managers|this is a new position|"
    "you build robots and verify their parts|you handle denied claims and expired policies|the closing date has been moved|you load and unload lorries|you will join our team|your text and samples show care|please apply with a letter|register your interest by post|please wait for our answer|ref 3a7c|ref: b21d|reference: 4711|our ref ab12, post 7"
).split("|")


def seeds() -> Iterator[tuple[str, int]]:
    """``(text, label)`` of the built-in examples."""
    for s in HTTPStatus:
        if s >= 400:
            yield f"{int(s)} {s.phrase}", 1
            yield f"Error {int(s)}: {s.phrase}", 1
            if s.description:
                yield s.description, 1
    for noun, gone in product(_NOUNS, _GONE):
        yield f"this {noun} {gone}", 1
    for entry, to in product(_ENTRY, _TO):
        yield f"please {entry} {to}", 1
        yield f"{entry} {to}", 1
    for switch, part in product(_SWITCH, _PARTS):
        yield f"please {switch} {part} in your browser", 1
    for texts in _SINGLE.values():
        for t in texts.split("|"):
            yield t, 1
    passage = _PASSAGE.split()
    for i in range(0, len(passage) - 7, 3):
        yield " ".join(passage[i : i + 8]), 1
    for t in _TEXT:
        yield t, 0
