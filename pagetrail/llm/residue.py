"""Template residue, filler, error messages and demands to allow scripts in page texts and titles."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.keys import bounded_broadcast_join
from pagetrail.session import cut

_NAME = r"[A-Za-z_][\w.-]*"
#: An unfilled placeholder of a template language: delimiters around a name or a short expression.
PLACEHOLDER = "|".join(
    [
        r"\{\{[^{}]+\}\}",
        r"\{%[^{}]+%\}",
        r"[$#]\{[^{}]+\}",
        rf"\{{{_NAME}\}}",
        r"<%[^<>]+%>",
        rf"%%{_NAME}%%",
        rf"@@{_NAME}@@",
        r"(?<!\w)__[A-Za-z][\w.]*?__(?!\w)",
        rf"\$[A-Za-z_][\w.]*\$",
        rf"\[\[{_NAME}\]\]",
        r"\[(?i:your|insert|enter|add|ihr|ihre|votre|su|tu) [^\[\]]+\]",
        r"(?<!\[)\[(?!(?i:sic|note|edit|video|photo|image|pdf|ad|ads|new|update|updated|citation|source|quote|bracket|laughter|applause)\])" + _NAME + r"\](?!\])",
    ]
)
#: A placeholder that the sentence talks about: named by the word right before it.
MENTION = r"(?i)\b(?:write|type|enter|use|insert|put|add|tag|token|variable|named|called|schreiben sie|écrivez|escriba)\s+[\"'“«`(]?(?-i:" + PLACEHOLDER + ")"

#: The usual filler Latin.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit "
    "voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt "
    "mollit anim id est laborum"
).split()

_PART = r"(?:headline|heading|title|text|name|content|copy|description|tagline|slogan|caption|image|logo|paragraph)"
#: Filler phrases as (stems, pattern).
FILLERS = [
    ("asdf|jklö|qwert", r"\b(?:asdf|qwertz?|jklö)\b.*\b(?:asdf|jklö|qwertz?)\b|^asdf\b"),
    (" here", rf"\b{_PART} (?:goes|go|comes) here\b"),
    ("", rf"^(?:insert|enter|add|type|edit) (?:your )?{_PART}(?: here)?\W*$"),
    ("replace this|change me", r"\breplace this (?:paragraph|text|line|section|sentence)\b|\b(?:please )?change me\b"),
    ("", r"^(?:todo|fixme|tbd)\b\W.*"),
    ("dummy|sample|placeholder|filler", r"\(dummy\)|\b(?:dummy|sample|placeholder|filler) (?:text|content|copy|description|title)\b"),
    ("platzhalter|blindtext|einfügen|remplacer|insérer", r"\bplatzhalter(?:text)?\b|\bblindtext\b|\b(?:überschrift|titel|text) (?:hier )?einfügen\b|\btexte? à remplacer\b|\binsérer (?:le |un )?(?:titre|texte)\b"),
    ("texto de|insert|texte|faux text", r"\btexto de (?:ejemplo|relleno|prueba)\b|\b(?:insertar|inserte) (?:el )?(?:título|texto)\b|\btexte? (?:d'exemple|de remplissage)\b|\bfaux texte\b"),
    ("", r"^(?:site|page|document|company|product) (?:title|name|tagline|slogan)$"),
    ("", r"^untitled(?: (?:document|page))?$|^(?:new|blank) page$"),
]

_STATUS = (
    r"(?:not found|forbidden|unauthori[sz]ed|bad (?:gateway|request)|gateway time-?out|internal server error|service (?:temporarily )?unavailable|"
    r"too many requests|gone|method not allowed|request time-?out|payment required|not acceptable|conflict|proxy error|server error)"
)
_THING = (
    r"(?:page|view|link|request|resource|server|shop|site|website|service|session|connection|application|app|address|url|file|document|content|"
    r"gateway|system|database|account)"
)
_FAILS = (
    r"(?:could not|couldn't|can ?not|can't) be (?:loaded|found|served|reached|opened|displayed|shown|processed|completed)|"
    r"(?:is|was) (?:currently |temporarily )?(?:not available|unavailable|blocked|refused|rejected|denied|down|offline|not reachable|unreachable|not found|forbidden)|"
    r"isn't available|(?:does not|doesn't|no longer) exists?|has (?:timed out|failed|expired|been (?:blocked|refused|reset|closed))|timed out|expired|failed|crashed|broke (?:off|down)|"
    r"returned an (?:unexpected|invalid|empty) (?:answer|response|result)|is not open to your account|may have been (?:moved|deleted|removed)|did not respond"
)
#: Messages as (stems, pattern): what matches a pattern contains one of its stems, so the pattern is tried only there. No stem: it is tried at the start only.
ERRORS = [
    ("", r"^(?:(?:http|error|fehler|erreur|status|code|código|código de error)\s*:?\s*)?[45]\d\d(?:\s*[-–—:.]?\s*" + _STATUS + r")?\W*$"),
    ("", r"^(?:error|fehler|erreur|errore|erro)(?: code)?\s*:?\s*\d{0,5}\b(?:\W+(?:ray|ref|reference|request|incident|trace|event)\W?(?:id)?\W+[\w-]+)?\W*$"),
    ("", r"^" + _STATUS + r"\W*$"),
    ("", r"^(?:access|permission) denied\b|^session (?:expired|timed out)\W*$|^" + _THING + r" (?:not found|unavailable|error|expired)\W*$"),
    ("not be |n't be |available|blocked|refused|rejected|denied|down|offline|reachable|not found|forbidden|exist|timed out|failed|expired|reset|closed|crashed|broke|unexpected|invalid|empty|not open|moved|deleted|removed|not respond", r"\b(?:the|this|that|your|our|requested)(?: requested)? " + _THING + r"(?: you (?:asked for|requested|are looking for))? (?:" + _FAILS + r")\b"),
    ("", r"^(?:oops|sorry|uh-?oh|whoops)\b\W.*\b(?:broke|wrong|fail|failed|can't|cannot|couldn't|error|not find|something)\b|^(?:oops\W+)?something (?:broke|went wrong)\b"),
    ("we could|we can|maintenance", r"\bwe (?:could not|couldn't|can ?not|can't) (?:open|load|find|reach|process|complete|show)\b|\b(?:down|closed) for maintenance\b"),
    ("too many requests|in again|again later", r"\byou have sent too many requests\b|\bplease (?:sign|log) in again\b|\btry again later\b"),
    ("unhandled|uncaught|error|exception|traceback|nullreference|stack trace", r"\b(?:unhandled|uncaught)\b.*\b(?:exception|\w*error)\b|^(?:fatal|sql|database|runtime|syntax|parse|server|type|value|network) ?error\b|\bexception\b.* (?:at|in) (?:line )?\d|^traceback\b|\bnullreference\b|\bstack trace\b"),
    # German, French and Spanish
    ("nicht gefunden|fehler|versuchen sie|zugriff", r"^(?:seite|datei|adresse) (?:wurde )?nicht gefunden\b|\binterner (?:server)?fehler\b|\bein fehler ist aufgetreten\b|\bversuchen sie es später\b|\bzugriff (?:verweigert|wurde verweigert)\b"),
    ("gedauert|antwortet|abgelaufen|fehlgeschlagen|nicht |existiert|blockiert|abgelehnt|verweigert|unerwartet", r"\b(?:die|der|das|diese|dieser|ihre|ihr|unser|unsere) (?:[\wäöüß]+e )?(?:seite|server|anfrage|link|sitzung|verbindung|ressource|adresse|ansicht|shop|laden|dienst|inhalt|vorgang)\b[^.]{0,20}\b(?:zu lange gedauert|antwortet nicht|abgelaufen|fehlgeschlagen|nicht (?:mehr )?(?:verfügbar|erreichbar|gefunden)|existiert nicht|blockiert|abgelehnt|verweigert|nicht geladen|unerwartete antwort|existiert nicht mehr)\b"),
    ("introuvable|erreur|accès|réessayer", r"\bpage introuvable\b|\bune erreur (?:est survenue|s'est produite)\b|\berreur (?:interne|du serveur)\b|\baccès (?:refusé|interdit)\b|\bveuillez réessayer\b"),
    ("expiré|échoué|n'est |n'existe|refusé|bloqué|interrompu|introuvable|pas pu|inattendue|répond|indisponible|trop de temps", r"\b(?:la|le|l'|cette|ce|votre|notre) ?(?:page|serveur|demande|ressource|lien|session|connexion|adresse|vue|boutique|service|requête|contenu|site)\b[^.]{0,24}?\b(?:expirée?|échoué|n'est (?:pas|plus) disponible|n'existe (?:pas|plus)|a été (?:refusée?|bloquée?|interrompue)|introuvable|pas pu être|inattendue|n'a pas répondu|ne répond (?:pas|plus)|indisponible|trop de temps)(?!\w)"),
    ("no encontrada|error|denegado|inténtelo", r"\bpágina no encontrada\b|\bse ha producido un error\b|\berror (?:interno|del servidor)\b|\bacceso denegado\b|\binténtelo (?:de nuevo|más tarde)\b"),
    ("caducado|expirado|fallado|no está|existe|rechazad|bloquead|denegad|encontrad|inesperada|no responde|tardado|no se ", r"\b(?:la|el|esta|este|su|nuestra|nuestro) (?:página|servidor|solicitud|recurso|enlace|sesión|conexión|dirección|vista|tienda|servicio|petición|contenido|sitio)\b[^.]{0,24}?\b(?:caducado|expirado|fallado|no está disponible|no (?:ya )?existe|ya no existe|(?:ha sido|fue) (?:rechazad|bloquead|denegad)[oa]|bloquead[oa]|no encontrad[oa]|inesperada|no responde|ha tardado demasiado|no se (?:pudo|ha podido))\b"),
    # Italian and Portuguese
    ("non trovata|não encontrada|verificato|ocorreu|negato|negado|riprova|novamente", r"\bpagina non trovata\b|\bpágina não encontrada\b|\b(?:si è verificato|ocorreu) um? ?(?:errore|erro)\b|\baccesso negato\b|\bacesso negado\b|\briprova(?:re)? più tardi\b|\btente novamente mais tarde\b"),
    ("scadut|expirou|fallit|falhou|non |não |esiste|risponde|bloccat|bloquead|rifiutat", r"\b(?:la|il|questa|questo|l'|a|o|esta|este) ?(?:pagina|página|server|servidor|sito|servizio|serviço|richiesta|risorsa|sessione|sessão|connessione|conexão|link)\b[^.]{0,30}?\b(?:scadut[ao]|expirou|fallit[ao]|falhou|non (?:è )?(?:disponibile|esiste|risponde|raggiungibile)|não (?:está disponível|existe|responde)|bloccat[ao]|bloquead[ao]|rifiutat[ao])\b"),
]

_SCRIPT = r"(?:javascript|java script|client-side scripts?|scripts?|js|skripte?n?)"
_DEMANDS = "|".join(
    [
        rf"\b(?:enable|activate|allow|turn(?:ing)? on|switch on|unblock)\b[^.]{{0,20}}\b{_SCRIPT}\b",
        rf"\b{_SCRIPT}\b[^.]{{0,25}}\b(?:off|disabled|blocked|deactivated|required|needed|necessary|on|enabled|allowed|missing|turned off)\b",
        rf"\b(?:needs?|requires?|relies on|depends on|blocks?|does not support|doesn't support|without|cannot run|runs only with|works only with)\b[^.]{{0,20}}\b{_SCRIPT}\b",
        rf"\b(?:aktivieren|aktiviere|erlauben|einschalten|benötigt|braucht|blockiert|ohne)\b[^.]{{0,30}}\b{_SCRIPT}\b|\b{_SCRIPT}\b[^.]{{0,20}}\b(?:aktivieren|deaktiviert|abgeschaltet|ausgeschaltet|blockiert|erforderlich|einschalten|erlauben|nötig)\b",
        rf"\b(?:activer|activez|autorise[rz]|exige|nécessite|requiert|bloque|sans)\b[^.]{{0,25}}\b{_SCRIPT}\b|\b{_SCRIPT}\b[^.]{{0,12}}(?:désactivés?|bloqués?|requis|nécessaires?|activés?)(?!\w)",
        rf"\b(?:active|activar|habilite|permita|requiere|necesita|exige|bloquea|sin)\b[^.]{{0,20}}\b{_SCRIPT}\b|\b{_SCRIPT}\b[^.]{{0,12}}\b(?:desactivados?|bloqueados?|habilitados?|necesarios?|activados?)\b",
        rf"\b(?:attivare|attiva|abilitare|abilita|consentire|richiede|blocca|senza|ative|ativar|habilitar|requer|exige|bloqueia|sem)\b[^.]{{0,25}}\b{_SCRIPT}\b|\b{_SCRIPT}\b[^.]{{0,15}}\b(?:disattivat[oi]|disabilitat[oi]|bloccat[oi]|necessari[oa]?|desativad[oa]s?)\b",
        r"^noscript\b",
    ]
)
SCRIPTS = [("script|skript|js", _DEMANDS)]

#: Lines that come with a message and are no content: advice, incident numbers, machine names, stack frames.
EXTRA = "|".join(
    [
        r"^(?:node|ref|reference|incident|trace|trace id|request id|ray id|id|code|server)\b[\s:#-]*[0-9a-f-]{4,}\W*$",
        r"^at [\w.$<>]+ ?\(.*\)$|^(?:file|in) \S+[, ]+line \d+",
        r"^(?:reload|refresh|retry|go back|back|home|try again|contact|report this|ok|close)\b.{0,60}$",
        r"^[\W\d_]+$",
    ]
)
#: Words of texts that write about such messages.
NARRATIVE = (
    r"\b(?:article|lesson|lessons|course|tutorial|guide|museum|glossary|survey|surveys|archive|release|compares|compared|explains|explained|fixes|generator|"
    r"beginners|book|film|reports|lists|devotes|teaches|history of|how to design|artikel|lektion|kurs|leçon|cours|lección|curso|artículo)\b"
)


#: White space as Unicode has it, for trimming.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def normalised(line: Column) -> Column:
    """A line in lower case with placeholders, addresses and whatever holds a digit (numbers, dates, times, hex ids) masked."""
    masked = F.when(line.rlike(r"[{\[<%@_$]"), F.regexp_replace(line, PLACEHOLDER, "‹p›")).otherwise(line)
    masked = F.lower(masked)
    masked = F.when(masked.rlike(r"[@/]|\.[a-z]"), F.regexp_replace(masked, r"https?://\S+|\b[\w.+-]+@[\w-]+\.[\w.]+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}\b(?:/\S*)?", "‹u›")).otherwise(masked)
    masked = F.when(masked.rlike(r"\d"), F.regexp_replace(masked, r"\b[a-f]{0,12}\d[\w:/-]*(?:[.,]\d[\w:/-]*)*", "0")).otherwise(masked)
    return F.when(masked.rlike(r"(?U)[\s&&[^ ]]|  "), F.regexp_replace(masked, r"(?U)\s+", " ")).otherwise(masked)


def _filler(low: Column) -> Column:
    """Filler Latin, few words again and again, rows of x, or a filler phrase."""
    # word sets instead of repeated groups: a regular expression would recurse once per word
    ws = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    n, kinds = F.size(ws), F.size(F.array_distinct(ws))
    latin = (n > 1) & F.forall(ws, lambda w: w.isin(LATIN))
    again = (kinds <= 4) & (n >= kinds * 2) & ~low.rlike(r"\d")
    # of five words with at most four kinds one comes twice, so most lines need no look at all their words
    few = F.filter(F.split(F.substring_index(low, " ", 6), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    doubtful = F.forall(F.slice(few, 1, 2), lambda w: w.isin(LATIN)) | (F.size(few) < 6) | (F.size(F.array_distinct(few)) < 6)
    crosses = low.rlike(r"^[x\s.,-]+$") & F.contains(low, F.lit("xx"))
    return (doubtful & (latin | again)) | crosses | _matches(low, FILLERS)


def _matches(low: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether one of the rules matches."""
    anchored = "|".join(pattern for stems, pattern in rules if not stems)
    tests = [low.rlike(anchored)] if anchored else []
    for stems, pattern in rules:
        if stems:
            # a loop over the stems keeps the generated code small enough to be compiled
            tests.append(F.exists(F.array(*map(F.lit, stems.split("|"))), lambda stem: F.contains(low, stem)) & low.rlike(pattern))
    return reduce(or_, tests)


def _is_message(low: Column, rules: list[tuple[str, str]], long: Column, first: Column) -> Column:
    """A line is a message if it matches; one of more than 40 words (a paragraph) if its first sentence does."""
    return _matches(low, rules) & (~long | _matches(first, rules))


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, evaluated once each: by way of a generator they aren't merged into what uses them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def judged(df: DataFrame, line: str, name: str) -> DataFrame:
    """Adds what ``line`` is: scripts, error, filler, extra (comes with a message), short (may be a menu word) or content; null for null."""
    x = F.col(line)
    df = _step(df, _low=F.lower(x), _long=F.substring_index(x, " ", 40) != x)
    low, long = F.col("_low"), F.col("_long")
    # the first sentence of a paragraph decides, as what follows may explain it
    first = F.coalesce(F.nullif(F.regexp_extract(low, r"^(.*?[.!?…])\s", 1), F.lit("")), low)
    df = _step(df, _message=F.when(_is_message(low, SCRIPTS, long, first), "scripts").when(_is_message(low, ERRORS, long, first), "error"))
    df = _step(df, _found=F.when(F.col("_message").isNotNull(), F.col("_message")).when(_filler(low), "filler"))
    found = F.when(F.col("_found").isNotNull() & ~low.rlike(NARRATIVE), F.col("_found"))
    short = (F.size(F.split(x, " ")) <= 4) & ~x.rlike(r"\d|[.!?]$")
    out = F.when(x.isNull(), None).when(found.isNotNull(), found).when(low.rlike(EXTRA), "extra").when(short, "short").otherwise("content")
    return _step(df, **{name: out}).drop("_low", "_long", "_message", "_found")


def _fields(fields: DataFrame) -> DataFrame:
    """Non-blank fields as ``(src, rec_id, field, website, holds, is_title, parts)``, parts being trimmed lines or parts of a title."""
    rows = fields.select("src", "rec_id", "field", F.coalesce("website", F.lit("")).alias("website"), F.col("text").alias("t")).where(F.col("t").rlike(r"(?U)\S"))
    holds = F.when(F.col("t").rlike(r"[{\[<%@_$]"), F.regexp_replace("t", MENTION, " ").rlike(PLACEHOLDER)).otherwise(False)
    is_title = F.col("field").endswith("title")
    ends = F.when(F.col("t").rlike(r"[\r\x0b\x0c\x{85}\x{2028}\x{2029}]"), F.regexp_replace("t", r"\R", "\n")).otherwise(F.col("t"))
    parts = F.when(is_title, F.split("t", r" [|·–—-] ")).otherwise(F.split(ends, "\n"))
    parts = F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    # by way of a generator lines are split once: filters on them aren't pushed below and repeated
    return rows.select("src", "rec_id", "field", "website", F.inline(F.array(F.struct(holds.alias("holds"), is_title.alias("is_title"), parts.alias("parts")))))


def recurring_lines(rows: DataFrame, wide_share: float) -> DataFrame:
    """``(h, sites, class, narrative)``: masked lines on at least ``wide_share`` of the websites (two at least), classified once each.

    Lines are masked and grouped by the exact hash of what is left, first per (hash, website), then per hash, both
    with map-side combining; the rules then read one line of each group.
    """
    # an empty line is added to every text, so its group counts all websites in the same scan
    lines = rows.where("not is_title").select("website", F.explode(F.array_distinct(F.concat("parts", F.array(F.lit(""))))).alias("line"))
    masked = lines.select("website", "line", F.xxhash64(normalised(F.col("line"))).alias("h"))
    once = masked.groupBy("h", "website").agg(F.min("line").alias("line"))
    counts = cut(once.groupBy("h").agg(F.count(F.lit(1)).alias("sites"), F.min("line").alias("line")).where("sites > 1 or line = ''"))
    all_sites = counts.where("line = ''").select("sites").first()
    least = max(2, int(wide_share * all_sites[0])) if all_sites else 2
    wide = counts.where((F.col("sites") >= least) & (F.col("line") != ""))
    return cut(judged(wide, "line", "class").select("h", "sites", "class", F.lower("line").rlike(NARRATIVE).alias("narrative")))


def residue(fields: DataFrame, wide_share: float = 0.02, notice_sites: int = 5) -> DataFrame:
    """``(src, rec_id, field, kind)``: fields that hold residue instead of content.

    ``fields`` has src, rec_id, field, website and text, one row per field. kind is ``placeholder`` (an unfilled
    placeholder anywhere that the sentence doesn't merely name), or, if nothing but menu words surrounds it,
    ``filler`` (short headings may stand between it), ``error`` or ``scripts``; ``notice`` is a text all of whose
    lines recur on many websites (``notice_sites`` at least), one of them a sentence, though no phrase rule knows it.

    Numbers, addresses, dates and placeholders are masked and all lines grouped by the exact hash of what is
    left, counting the websites that each occurs on. Groups on at least ``wide_share`` of all websites (two at
    least) are classified by phrase and placeholder rules, once each, and the class is carried back by the hash;
    short ones are menu words. A line that doesn't recur is judged by the same rules on the spot. A sentence
    that writes about messages isn't one. Most fields are settled by their longest line: only fields where it
    is no content, or recurs, have all their lines looked up. Null and blank fields are never cases, null
    websites count as one website, repeated rows are judged alike, other columns are ignored, texts, lines and
    placeholders of any length are read whole, an empty table gives no rows.
    """
    rows = _fields(fields)
    recurring = recurring_lines(rows, wide_share)
    longest = F.array_max(F.transform("parts", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    keys = ["src", "rec_id", "field"]
    told = rows.select(*keys, "holds", "is_title", "parts", F.when(~F.col("holds"), longest).alias("longest"))
    told = judged(told, "longest", "first_class").withColumn("h", F.xxhash64(normalised(F.col("longest"))))
    told = bounded_broadcast_join(told, recurring.select("h", "sites"), ["h"])
    open_fields = told.where(F.col("holds") | (F.col("first_class") != "content") | (F.col("sites").isNotNull() & ~F.col("is_title")))
    open_fields = cut(open_fields.select(*keys, "holds", "is_title", F.when(~F.col("holds"), F.col("parts")).alias("parts")))
    placeholders = open_fields.where("holds").select(*keys, F.lit("placeholder").alias("kind"))

    lines = open_fields.where("not holds").select(*keys, "is_title", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "line"))
    lines = bounded_broadcast_join(lines.withColumn("h", F.xxhash64(normalised(F.col("line")))), recurring, ["h"])
    recurs = F.col("sites").isNotNull()
    lines = judged(lines.withColumn("unknown", F.when(~recurs, F.col("line"))), "unknown", "own")
    lines = lines.select(*keys, "is_title", "n", "pos", recurs.alias("recurs"), "sites", "narrative", F.coalesce("class", "own").alias("class"))
    message = F.col("class").isin("scripts", "error", "filler")
    # a title may end in its site's name; any other short line beside a message must be a menu word
    foreign = (F.col("class") == "short") & ~F.col("recurs") & ~(F.col("is_title") & (F.col("pos") == F.col("n") - 1))
    per = lines.groupBy(*keys, "is_title").agg(
        F.min_by("class", F.when(message, F.col("pos"))).alias("kind"), F.bool_or(F.col("class") == "content").alias("content"),
        F.count_if(foreign).alias("foreign"), F.count_if(F.col("class") == "filler").alias("fillers"), F.count_if(message).alias("messages"),
        F.bool_and((F.coalesce("sites", F.lit(0)) >= notice_sites) & ~F.coalesce("narrative", F.lit(False))).alias("all_recur"), F.bool_or(F.col("class") == "content").alias("sentence"),
    )
    # a filler page may keep short headings of its own, not more than it has lines of filler
    spare = F.when(F.col("kind") == "filler", F.col("fillers")).otherwise(0)
    known = (F.col("messages") > 0) & ~F.col("content") & (F.col("foreign") <= spare)
    notice = ~F.col("is_title") & F.col("all_recur") & F.col("sentence")
    return placeholders.unionByName(per.where(known | notice).select(*keys, F.when(known, F.col("kind")).otherwise("notice").alias("kind")))
