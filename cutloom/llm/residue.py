"""Template residue and error-page text in place of content.

A text is split into lines and sentences; page furniture and markup are taken away; the rest is compared with its address slug
and title, if there are any. Placeholder detectors find values that were never filled in. What remains as a short, low-information
response is weighed by its words, and by host evidence: how many texts of how many sources consist of the same words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from re import _constants as sre
from re._parser import parse as sre_parse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.session import cut_lineage, spread

NAME = r"[^\W\d][\w.\- ]*?(?:\s\|\s[\w.\-:, |]+?)?"
#: Placeholders by template language, each under a mark that it holds. Anything but their closing stands between marks that nothing else has, else a name, with filters; blanks around it are allowed.
_PLACEHOLDERS = {
    "{{": [r"\{\{[^{}\n]*[^{}\s][^{}\n]*\}\}"], "${": [r"\$\{[^{}\n]*[^{}\s][^{}\n]*\}"], "#{": [r"#\{[^{}\n]*[^{}\s][^{}\n]*\}"], "<%": [r"<%(?:(?!%>)[^\n])*[^\s%](?:(?!%>)[^\n])*%>"], "{%": [r"\{%(?:(?!%\})[^\n])*[^\s%](?:(?!%\})[^\n])*%\}"],
    "[[": [rf"\[\[\s*{NAME}\s*\]\]"], "<<": [rf"<<\s*{NAME}\s*>>"], "‹": [rf"‹\s*{NAME}\s*›"], "@@": [r"@@[A-Za-z_][\w.\-]*@@"], "%(": [r"%\([\w.\-]+\)[sdifrx]"], "%%": [r"%%[A-Za-z_][\w.\-]*%%"], "*|": [r"\*\|[^|\n]{1,40}\|\*"],
    "__": [r"(?<!\w)__[A-Za-z][\w.\-]*?__(?!\w)", r"(?<![A-Za-z0-9_])__+[A-Za-z][A-Za-z0-9 ]*__+(?![A-Za-z0-9_])"],
    "%": [r"(?<![\w%])%[A-Za-z_][\w.\-]+%(?![\w%])"], "$": [r"(?<![\w$])\$[A-Za-z_][\w.\-]+\$(?![\w$])"], "{": [r"(?<![{$#\w%])\{[A-Za-z_][\w.\-]*\}(?!\})", r"(?<![\w{$#%])\{\d{1,2}\}(?!\})"],
    "[": [r"\[(?:your|insert|add|enter|falta|inserte|insertar|insérer|votre|ihr|su|tu)\s+[^\[\]\n]{1,50}\]", r"\[[^\[\]\n]{1,50}\s(?:here|à compléter|à remplir|hier eintragen|einfügen|por completar|aquí)\]"],
    "<": [r"<(?:your|insert|enter)\s+[^<>\n]{1,50}>", r"<[^<>\n/]{1,50}\s(?:here|hier eintragen|einfügen|à compléter|aquí)>"],
}
_ABOUT = re.compile(r"\b(?:code|templates?|placeholders?|renderer|replaces|output|vorlagen?|platzhalter|modèles?|plantillas?|syntax|formatting|variables?|lesson|tutorial)\b", re.I)
_OPEN, _CLOSE = "`\"'“”«»„‘’‹›", "`\"'“”«»‘’‹›"

_EMPTY = r"(?:undefined|null|NaN|None|nil|\[object Object\]|\(null\))"
_EMPTY_AFTER_LABEL = re.compile(rf"(?<![\"'\w])[^\W\d][\w ]{{0,30}}\s?[:=]\s?{_EMPTY}(?![\w\"'])")
#: Within a sentence: a value follows a word.
_EMPTY_WORD = re.compile(rf"(?<=[^\W\d][ ]){_EMPTY}(?![\w\"'`”»])")
#: A single one in the place of a value: after a greeting or a preposition, and before the end of the phrase or a function word.
_GREETING = r"(?:hello|hi|hey|dear|welcome(?: back)?|thanks|thank you|good (?:morning|evening|afternoon)|goodbye|bye|hallo|guten (?:tag|morgen|abend)|willkommen(?: zurück)?|danke|liebe[rs]?|bonjour|bonsoir|salut|bienvenue|merci|chère?|hola|buen[oa]s (?:días|tardes|noches)|bienvenid[oa]s?|gracias|querid[oa]|adiós)"
#: What stands where a greeting wants a name, and the greeting right before it.
_SLOT = re.compile(r"\[[^\[\]\n\d]{1,40}\]|<[^<>\n/\d]{1,40}>|\([A-Z_]{3,40}\)|%\w{2,40}")
_GREETS = re.compile(rf"\b{_GREETING},?\s$", re.I)
_PLACEHOLDER = [(mark, re.compile(p, re.I)) for mark, patterns in _PLACEHOLDERS.items() for p in patterns] + [("%", re.compile(r"(?<![\w%])%[A-Z][A-Z_]{2,}\b(?!%)"))]
_BEFORE = r"(?:by|on|at|from|with|for|in|of|von|vom|am|auf|mit|bei|für|aus|par|de|du|à|sur|avec|pour|dans|por|en|con|para|desde)"
_NEXT = r"(?=\s*(?:$|[.,;:!?()\[\]|/·–—-])|\s+(?i:on|in|at|by|and|or|with|from|for|to|is|was|has|und|im|am|auf|mit|von|bei|für|aus|ist|war|et|sur|dans|avec|par|pour|le|la|à|est|y|en|con|por|para|el|es)\b)"
_EMPTY_ALONE = re.compile(
    rf"\b(?i:{_BEFORE}|{_GREETING},?)\s(?P<a>undefined){_NEXT}|,\s(?P<b>undefined)(?=\s?!)"
    # Words with a reading of their own (nil in results, German null, English None) stand in few of these places.
    rf"|\b(?i:by|from|on|par|por|von|{_GREETING},?)\s(?P<c>nil){_NEXT}|\b(?i:by|par|por|{_GREETING},?)\s(?P<d>null|None){_NEXT}"
    r"|(?<=[^\W\d][ ])(?P<e>NaN(?!\w)|\(null\)|%[sdif](?!\w))|(?<=,[ ])(?P<f>NaN(?!\w)|\(null\)|%[sdif](?!\w))"
)
#: What names a value rather than being one, right before it.
_NAMES = re.compile(r"\b(?:about|words?|values?|terms?|called|named|means?|what|says|prints?|shows?|displays?|returns?|writes?|uses?|reads?|über|wort|wert|heißt|zeigt|schreibt|liest|mot|valeur|affiche|montre|écrit|lit|palabra|valor|muestra|escribe|lee)\s+$", re.I)
#: Verbs of discussion and quoting.
_DISCUSSES = re.compile(r"\b(?:explain(?:s|ed)?|show(?:s|ed|n)?|quote[sd]?|says|said|asks?|asked|writes?|wrote|reads?|replaces?|replaced|means?|meant|teach(?:es)?|taught|discuss(?:es|ed)?|demonstrates?|describes?|compares?|prints?|displays?|erklärt|zeigt|liest|schreibt|bedeutet|heißt|fragt|ersetzt|explique|montre|écrit|lit|signifie|demande|remplace|explica|muestra|escribe|lee|significa|pregunta|reemplaza)\b", re.I)
_OBJECT = re.compile(r"\[object Object\]|NaN:NaN|[$€£]\s?(?:NaN|undefined|null)\b")
_PRINTF = re.compile(r"(?<![\w%\"'`“«])%[sdif](?![\w\"'`”»])")

#: Words of page furniture in the four languages.
_FURNITURE = frozenset("""home clips about sign in up out log login terms privacy help back to the overview list menu contact search imprint
accueil extraits aide retour à la liste connexion conditions confidentialité start hilfe anmelden abmelden zurück zur übersicht impressum datenschutz
inicio ayuda entrar salir volver a lista privacidad términos""".split())
_SEPARATED = re.compile(r"\s*[|·•»>\-–—/]\s*")

#: What shows that a sentence tells of such texts rather than being one: quotes, verbs of saying and teaching, and where that is done.
_TALKS = re.compile(
    r"\b(?:quot(?:es?|ed|ing)|reads? (?:out|aloud)|says|said|asks|asked(?! for)|tells|told|explain(?:s|ed|ing)?|describ(?:es|ed)|discuss(?:es|ed)?|jok(?:es|ed)|laugh(?:s|ed)?|teach(?:es)?|writes|wrote|compares?|shows? (?:how|why|what)|talk(?:s|ed|ing)?"
    r"|lessons?|lectur\w+|tutorials?|courses?|articles?|essays?|speech|phrases?|audience|viewers|museums?|posters?|comedian|speaker|presenter|teacher|professor|in the shot|on purpose"
    r"|vortrag|vorlesung|kurs|artikel|erklär\w+|erzähl\w+|sagt|liest|schreibt|beschreibt|spricht|fragt|lach\w+|schild|plakat|zuschauer|publikum|lehrer\w*|geschichte|steht auf|es geht um|geht es um"
    r"|exposé|conférence|cours|article|expliqu\w+|racont\w+|dit|lit|écrit|décrit|parle|demande à|rit|rient|panneau|affiche murale|public|spectateurs?|professeur\w*|animat\w+|histoire"
    r"|charla|conferencia|clase|curso|artículo|explic\w+|cuent\w+|dice|lee|escribe|describe|habla|pregunta|ríen?|cartel|público|espectador\w*|profesor\w*|maestr\w+|historia)\b|[\"“”«»„`]", re.I,
)

#: Signs of a notice that scripts are needed: the thing, and what is asked.
_SCRIPT = re.compile(r"java\s?script|\bscript(?:s|ing)?\b|\bskripte?n?\b|\bcookies?\b", re.I)
_NEED = re.compile(
    r"need|turn(?:ed)? on|switch|enabl|allow|requir|accept|block|disabl|support|properly|\boff\b|without|cannot|will not|best with|braucht|benötig|aktivier|gesperrt|einschalten|schalte|zulassen|akzeptier|müssen|erforder|ohne|unterstütz"
    r"|besoin|activ|bloqu|nécess|requi|en charge|sans|autoris|necesita|habilit|desactiv|permit|acept|sin\b", re.I,
)

#: Reason phrases of HTTP, and the codes that come without one.
_REASONS = "bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|not acceptable|request time-?out|conflict|gone|length required|precondition failed|payload too large|uri too long|unsupported media type|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway time-?out"
_CODES = "400|401|403|404|405|408|410|413|414|429|500|501|502|503|504"
_BARE = re.compile(rf"\W*(?:(?:http|error|erreur|fehler)\W*)?(?:{_CODES})\W*", re.I)

#: What a service deals in, and so what an error is about.
_THING = re.compile(
    r"\b(?:(?:web)?(?:page|site)|homepage|link|url|address|file|folder|directory|content|clip|video|recording|transcript|caption|subtitle|document|resource|image|post|message|comment|feed|profile|stream|channel|playlist|playback|user|authentication|authori[sz]ation|server|service|host|gateway|database|connection|network|request|response|session|account|login|password|access|player|browser|app|application|system|upload|download"
    r"|(?:web)?seite|website|wiedergabe|nutzer|beitrag|nachricht|kommentar|kanal|profil|angebot|adresse|datei|ordner|inhalt|aufnahme|mitschnitt|transkript|untertitel|dokument|dienst|datenbank|verbindung|netz(?:werk)?|anfrage|antwort|sitzung|konto|anmeldung|kennwort|passwort|zugriff|zugang|anwendung"
    r"|lecture|utilisateur|publication|message|commentaire|chaîne|profil|authentification|lien|adresse|fichier|dossier|contenu|extrait|vidéo|enregistrement|transcription|légende|sous-titre|document|ressource|serveur|base de données|connexion|réseau|requête|demande|session|compte|accès|lecteur|navigateur|application"
    r"|reproducción|usuario|publicación|mensaje|comentario|canal|perfil|autenticación|página|sitio|enlace|dirección|archivo|fichero|carpeta|contenido|vídeo|grabación|transcripción|subtítulo|documento|recurso|servidor|servicio|base de datos|conexión|red|solicitud|petición|sesión|cuenta|acceso|reproductor|navegador|aplicación)(?:s|es|e|en|n|r)?\b", re.I,
)

#: That something failed, is not there, or is not allowed.
_FAIL = re.compile(
    r"not (?:be )?(?:found|available|reachable|accessible|supported|permitted|authori[sz]ed)|(?:can(?:not| not|['’]t)|(?:could|did|does|do|is|was|were)(?: not|n['’]t)) (?:be )?(?:find|found|load|open|reach|connect|process|display|show|play|retriev|fetch|complet|respond|answer|exist|available|work|located)"
    r"|no longer (?:exist|available|online|supported|here)|ha(?:s|ve) (?:been )?(?:removed|deleted|moved|expired|timed out|run out|suspended)|(?:may|might) have (?:expired|moved|been)|(?:temporarily|currently) (?:offline|down|closed|unavailable)|do(?:es)? not have (?:permission|access|rights)|lack the rights"
    r"|(?:was|were|been|is) (?:lost|deleted|removed|blocked|interrupted|disabled|suspended|rejected|closed)|unable to|trouble (?:finding|loading|opening|playing|connecting)|took too long|logged out|not allowed to|failed to|(?:are|is) (?:currently |temporarily )?offline|has ended|(?:is|are) (?:restricted|private|limited to|members only)|unavailable|unreachable|unauthori[sz]ed|forbidden|denied|refused|timed out|time-?out\b|expired|overloaded|failed to|failed\b|crashed|nothing (?:was )?found|invalid (?:request|link|address|key|session)"
    r"|nicht (?:mehr )?(?:gefunden|verfügbar|erreichbar|vorhanden|erlaubt|unterstützt|angezeigt|geladen|geöffnet|möglich)|existiert nicht|gibt es nicht mehr|antwortet nicht|k(?:ann|onnten?) nicht (?:\w+ ){0,3}werden|keine? (?:berechtigung|zugriff|verbindung)|abgelaufen|überlastet|gesperrt|gelöscht|entfernt worden|verweigert|fehlgeschlagen|(?:wurde|ist|sind) (?:\w+ ){0,2}(?:unterbrochen|gelöscht|entfernt|beendet|deaktiviert|abgelehnt)|konnten? (?:\w+ ){0,4}nicht"
    r"|introuvable|indisponible|inaccessible|n['’](?:existe|est) (?:plus|pas) ?(?:disponible|accessible|en ligne|autorisé)?|n['’](?:a|ai|ont|avons|avez) pas (?:pu|été)|(?:a|ont) été (?:supprim|interromp|bloqu|désactiv|retir|déplac|perdu)\w*|ne peut (?:pas )?(?:être|plus)|pas l['’]autorisation|pas autorisé|a expiré|expirée?\b|refusée?\b|interdite?\b|a été supprimée?|ne (?:répond|fonctionne) (?:pas|plus)|(?:limité|réservé|restreint)e?s? aux?\b|impossible d"
    r"|no (?:existe|está disponible|disponible|encontrad[oa]|(?:se )?(?:ha|hemos) podido|podemos|se (?:ha )?(?:encontr|pudo|puede)|encontramos|responde|funciona|tiene (?:permiso|acceso)|ha sido posible)|ha (?:caducado|expirado|fallado)|ha sido (?:eliminad|borrad|retirad|movid)|caducad[oa]|denegad[oa]|prohibid[oa]|(?:restringid|limitad|reservad)[oa]s? a\b", re.I,
)

#: What errors ask for.
_ACT = re.compile(
    r"^\W*(?:please|bitte|veuillez|merci de|por favor)\b|try (?:it )?again|retry|reload|refresh (?:the|this)|(?:come|check) back (?:soon|later|in a)|contact (?:the|your|our|us)|(?:sign|log) in again|go back to the (?:home|start)|wait (?:a|\w+) (?:minute|moment)"
    r"|(?:noch einmal|erneut|später) (?:\w+ )?(?:versuch|prob)|versuchen sie es|melden sie sich|neu laden|laden sie|kontaktieren sie|wenden sie sich|réessaye|réessayer|rechargez|actualisez|revenir plus tard|revenez|reconnectez|contactez|inténtelo|intentarlo|vuelva a|recargue|actualice|póngase en contacto", re.I,
)

#: Sentences that are an error by themselves.
_ERROR_STRONG = re.compile(
    rf"\b(?:{_CODES})\b\W{{0,3}}(?:{_REASONS})\b|bad gateway|gateway time-?out|internal server error|service unavailable|too many (?:\w+ )?(?:requests|attempts|connections)|rate limit|page not found|access (?:denied|refused)|permission denied|(?:something|things?) (?:broke|went wrong)|nothing to see here|sign in again|(?:http|error|erreur|fehler|status|code)\W{{1,4}}(?:code\W{{1,3}})?[45]\d\d\b"
    r"|(?:unexpected|unknown|internal|fatal|runtime|syntax|playback|network) error|(?:error|fehler|erreur) ?code\W{1,3}\w{3,}|error (?:has )?(?:occurred|establishing|while|loading|processing)|no (?:internet|network|signal|data) ?connection|no (?:internet|network)\b|(?:sign|log) in to (?:view|continue|see|watch|access|read)|panicked at|\b[A-Z]{2,4}-\d{4,5}:|(?:scheduled|under|for|planned) maintenance|not available in your|not reachable|no object under"
    r"|traceback \(most recent|exception\b|stack trace|core dumped|<error>|\"error\"\s*:|\w+error:|segmentation fault|connection (?:refused|reset|lost)|^\W*(?:fatal|panic|critical|uncaught)\b|\b(?:we|i) (?:are|were|am) (?:having (?:trouble|problems)|unable)|\bwe (?:could|can) ?(?:not|n['’]t)|\bwe (?:couldn|can)['’]t|socket hang up|index out of range|null ?pointer|is not a function"
    r"|zugriff (?:verweigert|nicht)|schiefgelaufen|nicht geklappt|zeitüberschreitung|melden sie sich an|bitte (?:anmelden|einloggen)|zu viele (?:anfragen|versuche|nutzer|zugriffe|verbindungen)|fehler (?:aufgetreten|beim)|wartungsarbeiten|wird gewartet"
    r"|accès (?:refusé|interdit)|délai (?:\S+ )?(?:dépassé|expiré)|(?:problème|erreur) (?:\w+ )?(?:est survenue?|s['’]est produite?|lors d)|erreur (?:inattendue|interne|inconnue)|vous connecter|connectez-vous|trop de (?:requêtes|demandes|tentatives)|(?:en|de) maintenance"
    r"|acceso (?:denegado|prohibido)|algo (?:falló|salió mal|ha ido mal)|inici[ae] sesión|iniciar sesión|demasiad[oa]s (?:solicitudes|peticiones|intentos)|error (?:inesperado|interno|desconocido|al )|(?:ha ocurrido|ha habido|ocurrió|se (?:ha producido|produjo)) un (?:error|problema|fallo)|(?:de|en) mantenimiento", re.I,
)
#: Codes that programs print; letters count.
_ERROR_CODE = re.compile(r"\bE(?:CONN[A-Z]+|TIMEDOUT|NOENT|ACCES|PIPE|HOSTUNREACH|ADDRINUSE)\b|\b[A-Z][a-z]+(?:[A-Z][a-z]+)*(?:Exception|Error)\b")
_ERROR_WEAK = re.compile(r"\b(?:error|errors|erreur|fehler|failure|warning|http|sorry|désolé|désolée|leider|lo sentimos|ticket|vorgang|dossier|caso|status|request|code|oops|unavailable|server|\w*exception|at \w+\.\w+|file \"[^\"]+\", line)\b|\w+d/\d+\.\d+", re.I)

#: Signs of filler: announced, stand-in or sample texts.
_FILLER = re.compile(
    r"lorem ipsum|dolor sit amet|(?:dummy|filler|sample|placeholder|example|your|some) (?:text|copy|paragraph|description|content|caption|title|sentence)(?: goes| here| to|\W*$| for)|(?:dummy|filler|sample|placeholder) (?:text|copy|paragraph|description|content|caption|title|sentence)|(?:text|content|description|more) (?:to come|to follow|will follow|follows)|(?:text|description|caption|content|title|copy) (?:goes|comes|will go|will be|will appear|belongs) here"
    r"|to be (?:replaced|added|written|done|announced|filled|determined|confirmed)|coming soon|(?:will be|to be) (?:added|available|updated|online) (?:later|soon|shortly)|under construction|^\W*placeholder\W*$|for layout only|replace (?:this|me|before)|^\W*tb[acd]\W*$|^\W*to ?do\W*$"
    r"|hier entsteht|im aufbau|demnächst|blindtext|platzhalter|beispiel(?:absatz|text)|mustertext|fülltext|(?:text|inhalt|beschreibung|weiteres|titel) (?:folgt|kommt)|hier (?:kommt|steht|folgt).{0,30}(?:hin\b|beschreibung|text)|bitte (?:ersetzen|ausfüllen)"
    r"|(?:texte|contenu|description|titre) (?:à venir|à compléter|à remplacer|provisoire|factice)|faux texte|viendra ici|(?:paragraphe|texte|phrase) d['’]exemple|à remplacer|texte de (?:remplissage|substitution)|bientôt disponible|en construction|site en travaux"
    r"|(?:texto|contenido|descripción|título) (?:pendiente|próximamente|provisional)|texto de (?:relleno|muestra|ejemplo|prueba)|(?:aquí irá|irá aquí)|párrafo de (?:muestra|ejemplo)|en construcción|por sustituir|marcador de posición|próximamente", re.I,
)

#: The words of the usual pseudo-Latin filler.
_LATIN = frozenset("""lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad
minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum
eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum nibh viverra quisque
ornare luctus porta facilis facilisis tellus mauris arcu odio vitae semper cursus erat pulvinar pulvis torna tortor lacus lectus risus justo massa
pellentesque vestibulum curabitur suspendisse aenean donec praesent vivamus phasellus nullam fusce integer maecenas morbi nunc""".split())
#: Keyboard mash and stand-in words of test entries.
_MASH = frozenset("asdf qwer asd sdf jkl jklö qwerty qwertz asdfgh xxx xxxx xx test testing tests foo bar baz blah bla foobar yyy zzz aaa abc hjkl uiop zxcv".split())

_MASHED = re.compile(r"(?:asdf?|sdf|qwer(?:ty?)?|jkl|hjkl|zxcv?|uiop)+")
#: What a program wrote, quotes and all.
_RAW = re.compile(r"\s*[\[{<]|traceback|file \"|uncaught|\w+error:", re.I)

_FORMAT = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
_WORDS = re.compile(r"[^\W\d_]+")
_NUMBERED = re.compile(r"\w*\d\w*")
_UNITS = re.compile(r"\n+|(?<=[.!?…])\s+|\s+/\s+")


#: Without any of these marks in a text none of its empty values can match.
_EMPTY_MARKS = ("undefined", "null", "NaN", "None", "nil", "[object", "(null)", "%s", "%d", "%i", "%f")


def _strings(items, most: int = 64) -> set[str] | None:
    """All strings, in lower case, that a part of a parsed pattern can match; None if they are many or unbounded."""
    found = {""}
    for op, value in items:
        if op is sre.LITERAL:
            more = {chr(value).lower()}
        elif op is sre.AT:
            more = {""}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value):
            more = {chr(v).lower() for _, v in value}
        elif op is sre.SUBPATTERN:
            more = _strings(value[3], most)
        elif op is sre.BRANCH:
            parts = [_strings(x, most) for x in value[1]]
            more = None if None in parts else set().union(*parts)
        elif op is sre.MAX_REPEAT and value[1] == 1:
            more = _strings(value[2], most)
            more = more if more is None or value[0] else more | {""}
        else:
            more = None
        if more is None or len(found) * len(more) > most:
            return None
        found = {x + y for x in found for y in more}
    return found


def _needed(items) -> set[str]:
    """Strings one of which every match of a part of a parsed pattern holds, the longest that can be proven; {""} if none can."""
    runs, run = [], []
    for item in items:
        if _strings([*run, item]) is not None:
            run.append(item)
            continue
        runs.append(_strings(run))
        op, value = item
        run = [item] if _strings([item]) is not None else []
        if op is sre.SUBPATTERN:
            runs.append(_needed(value[3]))
        elif op is sre.BRANCH:
            runs.append(set().union(*map(_needed, value[1])))
        elif op is sre.MAX_REPEAT and value[0]:
            runs.append(_needed(value[2]))
    return max([*runs, _strings(run)], key=lambda x: min(map(len, x)))


def _top(items) -> list:
    """The alternatives of a parsed pattern, each as a list of its items; those of a group that is all but ends of words too."""
    inner = [(op, value) for op, value in items if op is not sre.AT]
    if len(inner) == 1 and inner[0][0] is sre.SUBPATTERN:
        return _top(inner[0][1][3])
    if len(inner) == 1 and inner[0][0] is sre.BRANCH:
        return [x for branch in inner[0][1][1] for x in _top(branch)]
    return [list(items)]


#: For fragments that are too common: what holds, in lower case, where their signs do.
_PROBES = {"-": re.compile(r"[a-z]{2,4}-\d{4}"), " moment": _ACT, "noch einmal ": _ACT, "at ": re.compile(r"at \w+\.\w"), "d/": re.compile(r"d/\d+\.\d")}


@lru_cache(maxsize=1)
def fragments() -> dict[str, re.Pattern | None]:
    """Fragments one of which every error, filler or script sign holds, in lower case, taken from the patterns themselves.

    With a fragment comes the pattern to be run where it occurs; None if the fragment is enough.
    """
    found: dict[str, re.Pattern | None] = {}
    for pattern in (_ERROR_STRONG, _ERROR_CODE, _ERROR_WEAK, _FAIL, _ACT, _FILLER, _SCRIPT):
        for alternative in _top(sre_parse(pattern.pattern, pattern.flags)):
            for x in _needed(alternative):
                if not x:
                    raise ValueError(f"an alternative of {pattern.pattern[:40]}... has no fragment")
                found[x] = _PROBES.get(x, pattern if pattern is _SCRIPT else None)
    return found


@lru_cache(maxsize=1)
def _automaton():
    """Aho-Corasick automaton over the fragments: one pass tells that a text has no sign."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, pattern in fragments().items():
        automaton.add_word(word, pattern)
    automaton.make_automaton()
    return automaton


def has_sign(text: str) -> bool:
    """Whether a text may have a sign; without one its score, and that of each unit in it, is 0.

    Pseudo-Latin counts from more than half of the words of a unit: two such words are then neighbours, or one word apart.
    """
    lowered = text.lower()
    if not text.isascii():  # letters that patterns take for i and s in any case
        lowered = lowered.replace("i\u0307", "i").replace("ı", "i").replace("ſ", "s")
    tried = set()
    for _, pattern in _automaton().iter(lowered):
        if pattern is None:
            return True
        if pattern not in tried:
            if pattern.search(lowered):
                return True
            tried.add(pattern)
    tokens = _WORDS.findall(lowered)
    if not _MASH.isdisjoint(tokens) or any(map(_MASHED.fullmatch, tokens)):
        return True
    latin = [i for i, t in enumerate(tokens) if t in _LATIN]
    return any(j - i <= 2 for i, j in pairwise(latin))


def _discussed(text: str, start: int, end: int) -> bool:
    """Whether a placeholder is quoted, or stands in a sentence whose other words name templates and have a verb of discussion."""
    if start and text[start - 1] in _OPEN and text[end : end + 1] and text[end] in _CLOSE:
        return True
    a = max(text.rfind("\n", 0, start), *(text.rfind(x, 0, start) for x in (". ", "! ", "? ")))
    ends = [e for e in (text.find(x, end) for x in ("\n", ". ", "! ", "? ")) if e >= 0]
    around = (text[a + 1 : start], text[end : min(ends, default=len(text))])
    told = [v for x in around for v in _DISCUSSES.findall(x)]
    return len(told) > 1 or (bool(told) and any(map(_ABOUT.search, around)))


def _told(line: str, start: int, end: int) -> bool:
    """Whether an empty value is named, quoted, or stands in a sentence that discusses such values."""
    a = max(0, *(line.rfind(x, 0, start) + 1 for x in (". ", "! ", "? ")))
    b = min([e for e in (line.find(x, end) for x in (". ", "! ", "? ")) if e >= 0], default=len(line))
    before, after = line[a:start], line[end:b]
    if _NAMES.search(before) or any(before.count(o) > before.count(c) * (o != c) and c in after and (o != c or before.count(o) % 2) for o, c in (('"', '"'), ("`", "`"), ("“", "”"), ("„", "“"), ("«", "»"), ("»", "«"))):
        return True
    return any(_ABOUT.search(x) for x in (before, after)) and any(_DISCUSSES.search(x) for x in (before, after))


def unfilled(text: str) -> bool:
    """Whether a placeholder or an empty program value was left where a value belongs; quoted or discussed ones do not count."""
    if any(not _discussed(text, *m.span()) for mark, p in _PLACEHOLDER if mark in text for m in p.finditer(text)):
        return True
    if any(_GREETS.search(text, max(0, m.start() - 40), m.start()) and not _discussed(text, *m.span()) for m in _SLOT.finditer(text)):
        return True
    if not any(m in text for m in _EMPTY_MARKS):
        return False
    for line in text.split("\n"):
        if _OBJECT.search(line) or _EMPTY_AFTER_LABEL.search(line) or len(_PRINTF.findall(line)) > 1:
            return True
        if any(not _told(line, *m.span(m.lastgroup)) for m in _EMPTY_ALONE.finditer(line)):
            return True
        again = _EMPTY_WORD.findall(line)
        if len(again) > len(set(again)) and len(line.split()) <= 14:
            return True
    return False


def _is_furniture(line: str) -> bool:
    found = _WORDS.findall(line.lower())
    return not found or (len(found) <= 6 and all(w in _FURNITURE for w in found) and (len(found) > 1 or len(line.strip()) <= 12))


def body_units(text: str, slug: str | None = None, title: str | None = None) -> list[str]:
    """Lines and sentences of a text without markup, page furniture, and repetitions of its slug and title."""
    known = {" ".join(_WORDS.findall((x or "").lower().replace("-", " "))) for x in (slug, title)} - {""}
    lines = [x for x in _TAG.sub("\n", text).split("\n") if not _is_furniture(x)]
    return [u for line in lines for u in (x.strip() for x in _UNITS.split(line)) if u and " ".join(_WORDS.findall(u.lower())) not in known]


def unit_score(unit: str) -> int:
    """0 content, 1 a weak sign of residue, 2 residue, -1 talk about residue."""
    return full_score(unit) if has_sign(unit) else 0


def full_score(unit: str) -> int:
    """The score of a unit without a look at its fragments first."""
    tokens = [w.lower() for w in _WORDS.findall(unit)]
    n = len(tokens)
    if n and sum(t in _LATIN for t in tokens) * 2 > n and n > 2:
        return 2
    if n and sum(t in _MASH or _MASHED.fullmatch(t) is not None for t in tokens) * 4 >= n * 3:
        return 2
    fails, asks = _FAIL.search(unit), _ACT.search(unit)
    strong = _ERROR_STRONG.search(unit) or _ERROR_CODE.search(unit) or _FILLER.search(unit) or (_SCRIPT.search(unit) and _NEED.search(unit)) or (fails and (asks or _THING.search(unit)))
    if strong:
        return -1 if _TALKS.search(unit) and not _RAW.match(unit) else 2
    if fails or asks or _ERROR_WEAK.search(unit) or _SCRIPT.search(unit):
        return -1 if _TALKS.search(unit) and "file \"" not in unit.lower() else 1
    return 0


def signs(text: str, slug: str | None = None, title: str | None = None) -> tuple[bool, float, float, int, str, bool]:
    """(unfilled, share of residue words, share with weak ones, words, skeleton, mismatched) of a text.

    mismatched: none of the words of the text is one of its slug or title.
    """
    text = _FORMAT.sub("", unicodedata.normalize("NFKC", text))
    if _BARE.fullmatch(text):
        return False, 1.0, 1.0, 1, "#", True
    if not has_sign(text):
        return unfilled(text), 0.0, 0.0, 0, "", True
    raw = _TAG.search(text) and _ERROR_STRONG.search(text)
    units = body_units(text, slug, title)
    sizes = [max(1, len(_WORDS.findall(u))) for u in units]
    scores = [unit_score(u) for u in units]
    total = sum(sizes)
    strong = sum(n for n, s in zip(sizes, scores, strict=True) if s == 2)
    weak = sum(n for n, s in zip(sizes, scores, strict=True) if s >= 1)
    if total <= 30 and strong and -1 not in scores and len(units) > 1 and unit_score(" ".join(units)) == 2 and (weak * 3 >= total):
        strong = weak = total
    if raw and total <= 12 and -1 not in scores:
        strong = weak = total
    # Short lines of numbers or names between signs of an error (stack frames, codes) belong to it.
    if strong and total <= 40 and -1 not in scores and weak * 2 >= total:
        strong = weak
    skeleton = " ".join(_NUMBERED.sub("#", " ".join(units).lower()).split())
    named = {w for x in (slug, title) if x for w in _WORDS.findall(x.lower()) if len(w) > 3}
    mismatched = named.isdisjoint(w for u in units for w in _WORDS.findall(u.lower()))
    return unfilled(text), strong / total if total else 0.0, weak / total if total else 0.0, total, skeleton, mismatched


def residue(df: DataFrame, *, id_col: str, text_col: str, host_col: str, slug_col: str | None = None, title_col: str | None = None, least: float = 0.75, copies: int = 3, hosts: int = 2, short: int = 40) -> DataFrame:
    """Texts that hold unfilled placeholders or consist of filler, an error message or a script notice: id, unfilled, strong, weak, words, copies, hosts.

    A text is listed if a placeholder or empty program value was left in it; or if at least the share ``least`` of its words, without
    furniture and markup, lies in residue sentences; or if with weak signs that share is reached, it has at most ``short`` words, none of
    them in its slug or title, and texts of the same words come at least ``copies`` times from at least ``hosts`` hosts. Null, empty and blank
    texts are never listed. Repeated rows count once; texts are taken whole; an empty table gives none.
    """
    null = F.lit(None).cast("string")
    wanted = [F.col(c).cast("string") if c else null for c in (slug_col, title_col)]
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"), wanted[0].alias("slug"), wanted[1].alias("title"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, host, slug, title in batch.itertuples(index=False, name=None):
                found, strong, weak, words, skeleton, mismatched = signs(text, slug, title)
                if found or weak > 0:
                    out.append((key, host, found, strong, weak, words, skeleton if weak >= least and words <= short and mismatched else None))
            yield pd.DataFrame(out, columns=["id", "host", "unfilled", "strong", "weak", "words", "skeleton"])

    filtered = rows.filter("id is not null and text is not null and trim(text) != ''")
    signed = spread(filtered).mapInPandas(run, "id bigint, host string, unfilled boolean, strong double, weak double, words int, skeleton string")
    signed = cut_lineage(signed.withColumn("skeleton", F.when(F.col("skeleton").isNotNull(), F.xxhash64("skeleton"))))  # few rows; read twice below
    # Host evidence is pre-aggregated per skeleton; only low-information responses with some sign take part.
    evidence = signed.filter("skeleton is not null").groupBy("skeleton", "host").agg(F.count("*").alias("n")).groupBy("skeleton").agg(F.sum("n").alias("copies"), F.count("*").alias("hosts"))
    joined = signed.join(evidence, "skeleton", "left").fillna(0, ["copies", "hosts"])
    hit = F.col("unfilled") | (F.col("strong") >= least) | ((F.col("weak") >= least) & (F.col("words") <= short) & (F.col("copies") >= copies) & (F.col("hosts") >= hosts))
    return joined.filter(hit).groupBy("id").agg(*[F.max(c).alias(c) for c in ("unfilled", "strong", "weak", "words", "copies", "hosts")])
