"""Template residue and error-page text (problem 10).

Method. The slug and title terms of a page are set apart from its body terms, and what the body says is weighed.

* Slug and title: lines of site furniture are known by their form alone (heading markup, breadcrumb, navigation bar, title bar,
  copyright, request id, loading mark). The title in them is cut out of the body, and the document's own title in the
  catalogue stands for the address slug. A document with furniture and a body is *framed*.
* Host evidence (``recurring``): body lines of framed documents are counted over the corpus as shapes, numbers and the own title
  masked. A line that shares no term with its title and slug, yet stands in many documents of several sources (or under
  several titles, or in a share of one source), is a site's own line. A framed document whose body holds nothing
  else is a response page, in whatever language and wording, of any length. Nothing is listed for this.
* Information (``notice``): a body is low in information if each of its lines
  is machine output (a stack trace, a warning with its place, a JSON answer) or a statement whose letters lie
  mostly in the general vocabulary of web responses, of which at least one term is decisive (a failure, a refusal, scripts). The
  vocabulary is one of single word stems, not of phrases; texts that only speak about such things spend their words on other terms.
* Placeholder detectors: unfilled fields by the syntax of template languages, anywhere in a text.
* Filler: lines of one letter, keyboard rows or a repeated phrase by their form, runs of dummy Latin by share, and
  drafting notes by share of the vocabulary of layout.

No rule depends on the length of a text or of a line, or on the size of the corpus, but for the counts of host evidence.

Defined results. Null, empty and blank texts are never flagged. Repeated documents are judged alike. A document without
a known title is compared with the title in its own furniture only. Texts are used whole. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelgrid import session

_NAME = r"[\p{L}_][\p{L}\p{N}_ .\[\]-]*?"
_CAPS = r"\p{Lu}[\p{Lu}\p{N}_.\[\]]+?"
#: Unfilled template fields: patterns by a text that every match of them holds, which is looked for first, as bytes.
PLACEHOLDERS = {
    "{": (r"\{\{[^{}\n]++\}\}|\{%[^%\n]++%\}|[#$]\{" + _NAME + r"\}|\{\p{N}{1,2}\}|\{[\p{L}_][\p{L}\p{N}_.\[\] ]*+\}",),
    "$": (r"\$" + _CAPS + r"\$",),
    "%": (r"%\(" + _NAME + r"\)[sd]", r"(?<![\p{N}\p{L}])%" + _CAPS + r"%"),
    "<": (r"<<" + _NAME + r">>|<if " + _NAME + r">|<%[=-]?[^%<>\n]++%>", r"(?i:<(?:insert|enter|your|add) " + _NAME + r">)", r"(?i:^|[^\p{L}\n])(?i:dear|hello|hi|hallo|bonjour|cher|hola|estimado|ciao|gentile|caro),? <" + _NAME + r">"),
    "&lt;": (r"&lt;" + _NAME + r"&gt;",),
    "__": (r"__" + _CAPS + r"__",),
    "@@": (r"@@" + _CAPS + r"@@",),
    "[": (r"\[\[" + _NAME + r"\]\]|\[[\p{L}_][\p{L}\p{N}_ .\[\]-]*?(?: goes)? here\]|\[\p{Lu}{2,}+(?:_\p{Lu}++)*+(?:\[\p{N}++\])?\]", r"(?i:\[(?:insert|enter|your|add) " + _NAME + r"\])"),
    "(": (r"(?i:\((?:insert|enter|your|add) " + _NAME + r"\))",),
}

#: Words of the usual dummy Latin.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat "
    "nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum pellentesque turpis mauris "
    "vestibulum vivamus donec curabitur praesent aliquam cras morbi nunc"
)
#: The rows of letters on a keyboard.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")

#: Word stems of web responses by language. STRONG ones name a failure, a refusal or scripts, some by two words (joined by ``_``); USUAL ones go with them.
STRONG = {
    "en": "are_down is_down site_down blocked broken captcha denied disabled not_exist longer_exist enable error exception expired failed failure fatal forbidden not_found gateway invalid javascript js maintenance many_request missing noscript offline oops outage refused restricted script timed_out timeout time-out traceback unable unauthor unavailab uncaught unexpected unsupported verify went_wrong",
    "de": "aktivier abgelaufen deaktiviert existiert_nicht fehler gesperrt skript ungültig verweiger wartung nicht_gefunden",
    "fr": "activer bloqué désactiv erreur expiré indisponible interdit introuvable refusé pas_trouvé",
    "es": "active bloquea caduca denegad no_se_encontr habilit prohibid mantenimiento",
    "it": "abilita attiva bloccat errore negato scadut non_trovat stata_trovat vietat disattivat manutenzione",
    "pt": "ative bloquead erro não_encontrad expirou habilite indisponíve negado proibid manutenção",
    "nl": "fout niet_gevonden geweigerd inschakel verlopen onderhoud geblokkeerd storing",
    "pl": "błąd odmow wygas nie_znalezion włącz niedostępn zablokowan",
    "ru": "включите запрещ истек истёк не_найден недоступ ошибк отказано",
    "sv": "aktivera fel_uppstod hittades_inte nekad åtkomst utgått",
}
USUAL = {
    "en": "access account address again bad down exist found human robot went wrong look allow answer app appear application attempt availab back browser button check clear click client close code condition connect contact content continue cookie could country database delete doesn empty encounter entry establish expect extension feature file follow gone have home http https internal isn item later library link load locat log login long longer look many may met method moment move moved must network not on our over page password path perform permi player please press problem proceed process proper proxy reach record redirect refresh region reload remov reports request requir resource respon retry return run search seconds security see seem server service session shortly show sign site slow something soon sorry start status stay stop support switch system tell temporar there thread time timed title told traffic trouble try turn type unusual upstream url use user using verify version video view visit warning web website without work you your",
    "de": "anfrage angefordert bleib kein leer fehl gefunden existiert erreichbar zugriff serverfehler anmeld antwort anzeig aufruf benutzer bereich berechtigung besuch bitte browser cookie datei datenbank dienst eintrag erlaub erneut fehlen führt ihnen ihr ihre inhalt intern interner keine konnte leer link login melde momentan muss nicht nutzen seite server sitzung später support technisch treten um verbindung verfügbar versuch vorübergehend wurde zeit zugang zurzeit derzeit",
    "fr": "accès actuellement trouvé impossib affich autorisé base bientôt cette connect connexion contenu cookie demand disponible données existe fiche impossible interne lien momentané navigateur nécessaire page patient plus pouvez produite ressource reconnect revenir réessay secondes serveur service session site sont temporaire tard une utilis veuillez vidéo voir votre",
    "es": "acceso ahora encontr algo cargar conexión contenido cookie datos disponible enlace esta existe ficha fue hay interno intent mostrar navegador nuevo página para permiso podido puede recurso registro scripts segundos servicio servidor sesión sitio solicitad temporal tiempo usar usuario vuelva ver más tarde inténtelo",
    "it": "accesso attualmente trovata trovato browser caricare collegamento connessione contenuto cookie database disponibile esiste gli impossib interno momentane mostra non pagina permesso per possibile questa richiesta riprova riprovare risorsa scheda script secondi server servizio sessione sito spenti stata tardi temporanea utilizzare vedere verificato visualizzare",
    "pt": "acesso agora encontrad cookie conexão conteúdo disponível existe foi interno navegador novamente não página para permissão por favor recurso serviço servidor sessão site solicitad tarde temporariamente tente ver usar",
    "nl": "aanvraag bestaat gevonden browser deze gebruiken inhoud later niet opnieuw pagina probeer server sessie site tijdelijk toegang uw website weergeven beschikbaar bekijken verbinding",
    "pl": "aby istnieje dostęp znalezion jest nie nieprawidłow obsług ponownie później proszę przeglądark sesja serwer spróbuj strona strony stronę treść tymczasowo wyświetl",
    "ru": "браузер доступ найден сервер вашем времен доступн запрашиваем запрос извините не неверн обновите перезагруз повторите пожалуйста позже пользова попробуйте просмотр сайт сеанс сервис серверу соединен страниц существует чтобы этого этой",
    "sv": "din hittades åtkomst försök försöka igen inloggning inte kan kunde senare server sida sidan tillgänglig tjänst webbläsare för att visa",
}
#: The same for scripts that put no blanks between words; other signs of theirs that only bind are taken as usual.
STRONG_CJK = "見つかりません|エラー|拒否|有効にして|無効|利用できません|メンテナンス|期限切れ|未找到|错误|拒绝|启用|不可用|过期|维护"
USUAL_CJK = r"ページ|サーバー|サーバ|アクセス|サービス|ブラウザ|ブラウザー|リクエスト|コンテンツ|内部|お探し|現在|再度|後で|後ほど|権限|接続|表示|設定|存在|利用|画面|页面|页|服务器|服务|访问|浏览器|请|稍后|再试|权限|连接|会话|暂时|您|的|\p{IsHiragana}+"
#: Word stems of drafting notes, one of which has to be of DRAFT_STRONG; words of DRAFT_ALONE are a note by themselves.
DRAFT = (
    "add block body box building characters coming content copy delete demo demonstration description draft dummy empty example field filler fill fixme following follows goes going headline here heading image insert layout line live look "
    "paragraph placeholder place publication published put real replace sample section sentence show some soon subtitle summary synopsis tagline template test text title todo type under construction will words write written "
    "blindtext platzhalter mustertext beispieltext füllt folgt text zeilen ersetzen hier einfügen inhalt überschrift "
    "relleno ejemplo muestra texto líneas contenido aquí sustituir próximamente segnaposto esempio prova testo righe contenuto sostituire inserire qui arrivo factice remplissage texte faux lignes contenu remplacer insérer ici venir bientôt"
)
DRAFT_STRONG = "body coming construction copy demo draft dummy filler follows goes insert layout placeholder replace sample template written blindtext platzhalter mustertext beispieltext folgt ersetzen einfügen relleno ejemplo sustituir próximamente segnaposto sostituire inserire factice faux remplissage remplacer insérer bientôt text texte texto testo"
DRAFT_ALONE = "tbd|tba|todo|fixme|placeholder|lorem|platzhalter|blindtext|platzhaltertext|mustertext|segnaposto|relleno"


def one_of(words: list[str]) -> str:
    """Pattern of any of the words, by common beginnings, so that a matcher tries few branches at a place."""
    tails: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        tails.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(c + (one_of([t for t in rest if t]) + ("?" if "" in rest else "") if any(rest) else "") for c, rest in tails.items()) + ")"


def _words(tables: dict[str, str]) -> str:
    """Pattern of all words of the stems; short stems stand for short words only."""
    stems = [w.replace("_", " ") for t in tables.values() for w in t.split()]
    sized = lambda low, high: [w for w in stems if low <= len(w) <= high]
    exact, close, open_ = sized(1, 3), sized(4, 4), sized(5, 99)
    return "(?:" + "|".join([one_of(open_) + r"\p{L}*+"] + [one_of(w) + tail for w, tail in ((close, r"\p{L}{0,3}(?!\p{L})"), (exact, r"(?!\p{L})")) if w]) + ")"


_EDGE = r"(?iu)(?<![\p{L}\p{N}])"
#: Words of three letters at most bind others; a stem stands for all its words.
_SHORT = _EDGE + r"(?:\p{L}{1,3}|this|that|these|then|with|have|been|from|will|were|does|what|your|once|about|before|only|eine|einen|kann|muss|wird|dies|diese|dieser|diesen|dieses|müssen|sein|them|need|nous|elle|sont|peut|être|dans|pour|avant|ceci|está|este|esta|questo|questa|sono|della|pode)(?![\p{L}\p{N}])"
_RESPONSE = _EDGE + _words({"strong": " ".join(STRONG.values()), "usual": " ".join(USUAL.values())}) + "|" + STRONG_CJK + "|" + USUAL_CJK
#: A negation before a word of availability, in one sentence.
_AVAILABLE = "avail allow permit access load show display connect verfügbar anzeig angezeigt erreichbar disponib affich mostrar beschikbaar dostęp доступ tillgänglig".split()
_NEGATED = _EDGE + r"(?:not|no|can ?not|nicht|pas|non|não|niet|nie|не|inte|\p{L}+n't)(?!\p{L})[^.!?\n]*?(?<!\p{L})" + one_of(_AVAILABLE)
_STRONG = _EDGE + _words(STRONG) + "|" + STRONG_CJK
_STATUS = r"(?<![\p{N}\p{L}.,:/-])[45]\p{N}\p{N}(?![\p{N}\p{L}]|[.,:/-]\p{N})"
_DRAFT = _EDGE + one_of(DRAFT.split()) + r"\p{L}{0,3}(?!\p{L})"
_DRAFTED = _EDGE + one_of(DRAFT_STRONG.split()) + r"\p{L}{0,3}(?!\p{L})"
_LATIN = _EDGE + one_of(LATIN.split()) + r"(?![\p{L}\p{N}])"
_LATIN_WORD = one_of(LATIN.split())
#: A run of dummy Latin inside other text: seven words after a divider, four if it begins as it usually does.
_LATIN_RUN = r"(?<![\p{L}\p{N}])(?i:lorem[\s.,;]+ipsum(?:[\s.,;]+" + _LATIN_WORD + r"){2}|(?<=[\s.,;])" + _LATIN_WORD + r"(?:[\s.,;]+" + _LATIN_WORD + r"){6})(?![a-zA-Z])"
_RUNS = one_of([row[i:j] for row in ROWS for i in range(len(row)) for j in range(i + 2, len(row) + 1)])
#: Whole lines of filler by their form: one letter, keyboard rows (ten letters at least), a phrase said three times or more, a note that is marked as one.
_FORMS = (
    r"[x]++(?:[ \t]++[x]++){2,}+[ \t.]*+",
    r"(?=(?:[^\p{L}\n]*\p{L}){7})(?=[^\n]*[ \t])(?:" + _RUNS + r"[ \t.;]*+){2,}+",
    r"(?<phrase>\p{L}+(?: \p{L}+){0,3})(?:[ ,.!]+\k<phrase>){2,}+[ .,!]*+(?:\p{L}+[ .]*+)?",
    r"\W{0,4}(?:todo|fixme|tbd)\s*:.*+",
)
FILLER_FORM = r"(?imu)^[ \t]*(?:" + "|".join(_FORMS) + ")$"

#: Lines of site furniture by their form: heading, breadcrumb, navigation, copyright, an id, a loading mark; the first line may be a title bar.
_HEADING = r"(?s)<h(\d)>(.*)</h\1>"
_CRUMBS = r"[^>|\n]+(?: > [^>|\n]+)* > (.+)"
_BAR = r"(.+) [–—|-] (\p{Lu}[^–—|.!?:;,\"\n]*)"
FURNITURE = r"<h\d>.*</h\d>|[^>|\n]+(?: > [^>|\n]+)* > .+|[^|\n]+(?: \| [^|\n]+){2,}|©.*|\([cC]\) .*|\p{Lu}[\p{L} ]*?:? (?=[0-9a-fA-F-]*\d)[0-9a-fA-F-]{5,}|\p{Lu}\p{Ll}+(?:…|\.\.\.)|(?i:back|return|go back) to (?i:the )?\p{L}+(?: page)?"

#: Machine output: frames of a trace, its head, code, the exception; a warning with its place; an answer in JSON.
_TRACE = r"at [\p{L}\p{N}_.$<>/\[\]-]+ ?\(.*\)|at .+:\d+:\d+|File \".+\", line \d+.*|Traceback \(.*\):|\#\d+ .+(?:\(\d+\)|:\d+).*|Caused by: .+|\.\.\. \d+ more|[\p{L}\p{N}_.$]*(?:Error|Exception)(?::.*)?|(?:Exception in thread|Uncaught) .+"
_CODE = r"(?:return|raise|throw|pass|yield|await|import|from|if|for|while|with|def|self)\b.*|.*[=\[\](){};].*"
_WARNED = r"(?i)(?:php )?(?:fatal error|parse error|warning|notice|uncaught [\p{L}\p{N}_.]+): .+ (?:on line \d+|in \S+:\d+)\.?"
_JSON = r"(?s)\s*\{.*\"(?i:status|statusCode|code|error|errors|message|detail)\"\s*:.*\}\s*"


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    found = text.rlike(patterns[0])
    for p in patterns[1:]:
        found = found | text.rlike(p)
    return found


def unfilled(text: Column) -> Column:
    """Whether a text has an unfilled template field."""
    found = F.lit(False)
    for part, patterns in PLACEHOLDERS.items():
        found = found | (text.contains(part) & matches(text, patterns))
    return found


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def _shares(line: Column, vocabulary: str) -> tuple[Column, Column, Column]:
    """Letters of a line in words of a vocabulary, letters in other words, and the number of the former's words; binding words do not count."""
    telling = F.regexp_replace(line, _SHORT + "|" + vocabulary, "")
    bound = F.regexp_replace(line, vocabulary, "")
    return _letters(line) - _letters(bound), _letters(telling), F.regexp_count(line, F.lit(vocabulary))


def decisive(line: Column) -> Column:
    """Whether a line names a failure, a refusal or scripts."""
    return line.rlike(_STRONG) | line.rlike(_STATUS) | line.rlike(_NEGATED) | line.rlike(f"^(?:{_WARNED})$")


def _anywhere(*parts: str) -> str:
    """Pattern of words at their beginnings, for a search only: the sign before a word is taken, which costs less than looking behind at every place."""
    return r"(?iu)(?:^|[^\p{L}\p{N}])(?:" + "|".join(p.removeprefix(_EDGE) for p in parts) + ")"


def hinted(text: Column) -> Column:
    """Whether a text has a decisive term or a mark of machine output at all, so that its lines have to be weighed."""
    # one pattern, as each one has to decode the text
    marks = r"[45]\p{N}\p{N}(?![\p{N}\p{L}])|at [^\n]+\(|line \d|(?:status|statuscode|code|errors?|message|detail)\"|[" + "".join(sorted({w[0] for w in STRONG_CJK.split("|")})) + "]"
    return text.rlike(_anywhere(_words(STRONG), _NEGATED, marks) + "|" + f"(?:{STRONG_CJK})")


#: How many letters of the vocabulary a statement has for one in other words, and before its title is known.
SHARE, OPEN_SHARE = 2.25, 1.0
#: Words that tell of a person; a page speaks of itself and to its reader.
_TOLD = _EDGE + r"(?:he|she|his|her|him|himself|herself|ella|él|lei|он|она|er)(?![\p{L}\p{N}])"


def statement(line: Column, share: float = SHARE) -> Column:
    """Whether a line says little that is not in the vocabulary of web responses."""
    mine, other, words = _shares(line, _RESPONSE)
    said = ((mine >= other * share) & (words >= 3)) | ((other == 0) & ((words >= 2) | line.rlike(_STATUS) & (words >= 1)))
    return (said & ~line.rlike(_TOLD)) | line.rlike(f"^(?:{_WARNED})$")


def machine(lines: Column) -> Column:
    """Whether all lines are the output of a program."""
    traced = F.exists(lines, lambda x: x.rlike(f"^(?:{_TRACE})$")) & F.forall(lines, lambda x: x.rlike(f"^(?:{_TRACE}|{_CODE})$"))
    return traced | F.forall(lines, lambda x: x.rlike(f"^(?:{_WARNED})$")) | F.array_join(lines, "\n").rlike(f"^(?:{_JSON})$")


def filler_line(line: Column) -> Column:
    """Whether a line is dummy Latin or a drafting note by share."""
    latin = (F.regexp_count(line, F.lit(_LATIN)) >= 4) & (_letters(F.regexp_replace(line, _LATIN, "")) * 4 <= _letters(line))
    mine, other, words = _shares(line, _DRAFT)
    noted = ((words >= 3) & (mine >= other * 1.5)) | ((words >= 2) & (other == 0)) | line.rlike(r"(?i)^\W*(?:" + DRAFT_ALONE + r"|to be (?:written|added|done|continued here))\W*$")
    return latin | line.rlike(_EDGE + "(?:" + DRAFT_ALONE + r")(?![\p{L}\p{N}])") & (other <= 2) | (noted & line.rlike(_DRAFTED + "|" + _EDGE + "(?:" + DRAFT_ALONE + "|written|added|done|continued)"))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, which are computed once for each row: a later filter on them is not pushed to where it would compute them again."""
    made = df.withColumn("__made", F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
    return made.select(*df.columns, "__made.*")


def residue(docs: DataFrame, titles: DataFrame, least_copies: int = 5, least_hosts: int = 2, least_alone: int = 20, least_share: float = 0.0001, least_titles: int = 3) -> DataFrame:
    """(doc_id, evidence) of the flagged documents; evidence is placeholder, filler, recurring or notice.

    ``docs`` has doc_id, text, source and tconst; ``titles`` (tconst, title) gives the titles that documents belong to. A line
    is a site's own if it has ``least_copies`` in ``least_hosts`` sources, or ``least_titles`` under different titles of
    several sources, or in one source ``least_alone`` and ``least_share`` of its documents. A line that names its own title has to
    do so under different titles, as copies of a real page stand under one.
    """
    real = docs.select("doc_id", "text", "source", "tconst").filter(F.col("text").rlike(r"\S"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\r\u00a0"))), lambda x: x != "")
    barred = lambda x, k: (k == 0) & x.rlike(f"^{_BAR}$") & F.col("text").rlike(r"^\s*[^\n]+\n\s*\n")
    split = _once(_once(real, lines=lines), side=F.filter("lines", lambda x, k: x.rlike(f"^(?:{FURNITURE})$") | barred(x, k)))
    body = F.filter("lines", lambda x, k: ~(x.rlike(f"^(?:{FURNITURE})$") | barred(x, k)))
    # the title in the furniture: of a heading, else the end of a breadcrumb, else the start of a title bar
    cut = lambda x: F.coalesce(*[F.nullif(F.regexp_extract(x, f"^{p}$", g), F.lit("")) for p, g in ((_HEADING, 2), (_CRUMBS, 1), (_BAR, 1))])
    headed = _once(split, body=F.when(F.size("side") == 0, F.col("lines")).otherwise(body), head=F.get(F.filter(F.transform("side", cut), lambda h: h.isNotNull()), F.lit(0)))
    framed = (F.size("body") > 0) & (F.size("side") > 0)
    bare = F.when(F.col("head").isNotNull(), F.transform("body", lambda x: F.replace(x, F.col("head"), F.lit("\u00a4")))).otherwise(F.col("body"))
    output = machine(F.col("body"))
    # lines that may be statements once the catalogue's title is cut out too
    low = hinted(F.col("text")) & (F.size("body") > 0) & (output | (F.forall("said", lambda x: statement(x, OPEN_SHARE)) & F.exists("said", decisive)))
    # a share is taken of lines and of sentences, where a text has a word of the kind at all
    pieces = F.flatten(F.transform("lines", lambda x: F.concat(F.array(x), F.split(x, r"(?<=[.!?])\s+"))))
    drafted = F.col("text").rlike(_anywhere(_DRAFTED, f"(?:ipsum|dolor|{DRAFT_ALONE}|added|done|continued)")) & F.exists(pieces, filler_line)
    filler = matches(F.col("text"), (_LATIN_RUN, FILLER_FORM)) | drafted
    # in this order, as each is only asked where those before it have not decided
    first = F.when(unfilled(F.col("text")), "placeholder").when(filler, "filler")
    judged = _once(_once(_once(headed, said=bare, framed=framed), sure=first), low=F.col("sure").isNull() & low)
    # the texts are read once: what is flagged or framed is written, and it is little
    kept = judged.filter("sure is not null or framed or low")
    held = session.cut(kept.select("doc_id", "source", "tconst", "sure", "framed", "low", "head", F.when(F.col("sure").isNull(), F.col("said")).alias("said")), "residue")
    sure = held.filter("sure is not null").select("doc_id", F.col("sure").alias("evidence"))
    named = titles.filter("tconst is not null and title is not null").groupBy("tconst").agg(F.min("title").alias("title"))
    terms = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 3)
    slug = F.when(F.length("title") > 0, F.transform("said", lambda x: F.replace(x, F.col("title"), F.lit("\u00a4")))).otherwise(F.col("said"))
    own = held.filter("sure is null").join(named, "tconst", "left").withColumns({"said": slug, "own": terms(F.concat_ws(" ", "head", "title"))})
    own = own.withColumn("low", F.col("low") & (machine(F.col("said")) | (F.forall("said", lambda x: statement(x)) & F.exists("said", decisive))))
    shape = lambda x: F.xxhash64(F.regexp_replace(F.regexp_replace(F.lower(x), r"\b[0-9a-f]*\d[0-9a-f]*\b", "0"), r"\s+", " "))
    # a line of the document's own title or slug is never the site's
    shaped = F.array_distinct(F.transform("said", lambda x: F.when(~F.arrays_overlap(terms(x), F.col("own")), shape(x)).otherwise(F.lit(None).cast("long"))))
    pages = own.withColumn("shapes", F.when(F.col("framed"), shaped)).select("doc_id", "source", "low", F.coalesce("head", "title", F.lit("")).alias("page"), "shapes", F.exists("said", lambda x: x.contains("\u00a4")).alias("named"))
    said = pages.select("source", "page", F.explode("shapes").alias("shape"), "named").filter("shape is not null")
    size = docs.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("size"))
    per_host = said.groupBy("shape", "source").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("p0"), F.max("page").alias("p1"), F.max("named").alias("named")).join(size, F.col("source").eqNullSafe(F.col("of")))
    alone = (F.col("n") >= least_alone) & (F.col("n") >= least_share * F.col("size"))
    shapes = per_host.groupBy("shape").agg(F.sum("n").alias("n"), F.count("source").alias("hosts"), F.max(alone).alias("alone"), F.max("named").alias("named"), (F.min("p0") != F.max("p1")).alias("mixed"))
    site = shapes.filter((F.col("alone") & (~F.col("named") | F.col("mixed"))) | ((F.col("hosts") >= least_hosts) & (((F.col("n") >= least_copies) & ~F.col("named")) | (F.col("mixed") & (F.col("n") >= least_titles))))).select("shape", F.lit(True).alias("known"))
    # a page is open as long as one of its lines is not the site's
    unknown = pages.select("doc_id", F.explode("shapes").alias("shape")).join(site, "shape", "left").groupBy("doc_id").agg(F.min(F.col("known").isNotNull()).alias("recurring"))
    weighed = pages.select("doc_id", "low").join(unknown, "doc_id", "left")
    open_ = weighed.select("doc_id", F.when(F.col("recurring"), "recurring").when(F.col("low"), "notice").alias("evidence")).filter("evidence is not null")
    return sure.unionAll(open_)
