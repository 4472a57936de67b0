"""Seed text for the residue models: what web pages, templates and page builders in general say, in several languages.

Nothing here comes from a corpus.  The seeds start the models; what a corpus says in its own words is learnt from it
(p09_residue).  Placeholders are made by a rule: the delimiters of template languages around names of fields."""

from __future__ import annotations

import random
from itertools import product

# The status codes of HTTP with their reason phrases.
STATUS = {
    400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 406: "Not Acceptable", 408: "Request Timeout", 409: "Conflict",
    410: "Gone", 413: "Content Too Large", 414: "URI Too Long", 415: "Unsupported Media Type", 418: "I'm a teapot", 422: "Unprocessable Content", 429: "Too Many Requests", 451: "Unavailable For Legal Reasons",
    500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout", 505: "HTTP Version Not Supported", 507: "Insufficient Storage", 508: "Loop Detected",
}
STATUS_FORMS = ("{c} {r}", "Error {c}: {r}", "Error {c} - {r}", "HTTP {c} {r}", "HTTP Error {c}. {r}", "HTTP/1.1 {c} {r}", "{c} - {r}", "{c}. That's an error.", "Error {c}", "Fehler {c}", "Erreur {c}", "Errore {c}", "Status: {c} {r}", "{r} ({c})")
THINGS = ("page", "file", "document", "resource", "URL", "item", "image", "record", "site", "content", "link", "article", "entry", "object", "video")
#: What page builders ask for, alone and as "... of the ...".
CONTENTS = ("text", "title", "subtitle", "heading", "caption", "description", "summary", "abstract", "introduction", "biography", "note", "content", "paragraph", "story", "quote", "address", "name", "image", "details", "history")
OWNERS = ("author", "owner", "company", "item", "page", "project", "event", "product", "object", "place")
SCRIPTS = ("JavaScript", "JavaScript and cookies", "scripts", "scripting", "JS", "client-side scripting", "active scripting")
APPS = ("site", "page", "website", "app", "application", "viewer", "reader", "player", "map", "catalogue", "tool", "form", "widget", "service")
FIELDS = (
    "name", "first name", "last name", "full name", "title", "subtitle", "author", "date", "year", "month", "time", "address", "city", "country", "place", "phone", "email", "company", "company name", "amount", "price", "total",
    "quantity", "count", "number", "id", "user", "username", "password", "url", "link", "image", "caption", "description", "summary", "abstract", "content", "text", "body", "message", "subject", "category", "label", "tag", "type",
    "status", "language", "version", "page", "page number", "order number", "invoice number", "reference", "customer", "client", "recipient", "sender", "signature", "owner", "editor", "publisher", "source", "topic", "keyword", "item",
    "product", "product name", "location", "library", "score", "size", "start date", "end date", "line", "section", "header", "footer", "value", "key", "index", "code", "note", "comment", "details",
)
#: ~ stands for each of THINGS (in FILLER of CONTENTS), ^ of SCRIPTS, @ of APPS.
NOTICES = """
The requested ~ was not found on this server.
The requested ~ could not be found.
The ~ you requested could not be found.
We couldn't find the ~ you were looking for.
The ~ you are looking for does not exist.
The ~ you are looking for might have been removed, had its name changed, or is temporarily unavailable.
The ~ you are trying to reach no longer exists.
This ~ doesn't exist or has been moved.
This ~ has been removed or deleted.
This ~ is no longer available.
This ~ is not available right now.
Sorry, this ~ is not available.
Sorry, we can't find that ~.
Sorry, the ~ could not be loaded.
Oops! That ~ can't be found.
~ not found
The ~ cannot be displayed.
The ~ is temporarily unavailable.
Failed to load the ~.
The ~ failed to load.
Unable to load the ~.
Could not retrieve the ~: the request timed out.
Timeout while loading the ~.
An error occurred while loading the ~.
Error: the ~ could not be opened.
You don't have permission to access this ~.
You are not authorized to view this ~.
You must be logged in to view this ~.
Access to this ~ is forbidden.
Access denied.
Access to the requested resource has been denied.
Your request has been blocked.
The request was blocked for security reasons.
The server encountered an internal error and was unable to complete your request.
The server is temporarily unable to service your request due to maintenance downtime or capacity problems.
The server did not respond in time.
The service is temporarily unavailable. Please try again later.
Something went wrong.
Something went wrong. Please try again later.
Oops, an unexpected error occurred.
An error has occurred.
We are sorry for the inconvenience.
Please try again in a few minutes.
Please try again later.
Try again in 30 seconds.
Retry after 60 seconds.
Please reload the page.
Check the address for typing errors and reload the page.
Check the URL and try again.
Return to the home page.
Go back to the previous page.
Please contact the site administrator if the problem persists.
Contact support if this continues.
Rate limit exceeded.
Too many requests. Slow down.
You have sent too many requests in a given amount of time.
Too many requests from this IP address.
Your session has expired. Please sign in again.
Session timed out, please log in again.
Invalid or expired token.
Request failed with status code 500
Request ID: 9f86d081884c7d65
Incident ID: 2c26b46b
Error reference #18a4f3
Ray ID: 7d865e959b2466918c9863
Unable to connect to the server.
The connection has timed out.
The connection was reset.
Connection refused by the server.
Network error, please check your connection.
This site can't be reached.
The site is down for maintenance. We'll be back soon.
The proxy server received an invalid response from an upstream server.
Error establishing a database connection
Could not connect to the database.
Warning: include(config.php): failed to open stream: No such file or directory in /var/www/html/index.php on line 12
Fatal error: Uncaught Exception: connection failed in /var/www/html/index.php on line 12
Fatal error: Allowed memory size exhausted in index.php on line 7
Parse error: syntax error, unexpected end of file in view.php on line 3
Traceback (most recent call last):
File "app.py", line 10, in main
KeyError: 'name'
TypeError: object is not callable
ValueError: invalid literal for int()
Uncaught ReferenceError: value is not defined
Uncaught TypeError: Cannot read properties of undefined
Exception in thread "main" java.lang.NullPointerException
Die angeforderte Seite wurde nicht gefunden.
Die Seite konnte nicht gefunden werden.
Seite nicht gefunden
Diese Seite ist nicht mehr verfügbar.
Ein Fehler ist aufgetreten. Bitte versuchen Sie es später erneut.
Interner Serverfehler
Zugriff verweigert.
Der Dienst ist vorübergehend nicht verfügbar.
Der Server antwortet nicht.
La page demandée est introuvable.
La page que vous cherchez n'existe pas ou a été déplacée.
Page introuvable
Une erreur est survenue. Veuillez réessayer plus tard.
Erreur interne du serveur
Accès refusé.
Le service est temporairement indisponible.
Le serveur ne répond pas.
La página solicitada no existe.
No se ha encontrado la página que busca.
Página no encontrada
El documento solicitado no está disponible.
Se ha producido un error. Inténtelo de nuevo más tarde.
Error interno del servidor
Acceso denegado.
El servicio no está disponible temporalmente.
El servidor no responde.
La pagina richiesta non è stata trovata.
La pagina cercata non esiste.
Pagina non trovata
Si è verificato un errore. Riprova più tardi.
Errore interno del server
Accesso negato.
Il servizio non è al momento disponibile.
Il server non risponde.
Pàgina no trobada. La pàgina sol·licitada no existeix.
Página não encontrada. A página solicitada não existe.
Pagina niet gevonden. De opgevraagde pagina bestaat niet.
Страница не найдена. Запрашиваемая страница не существует.
Η σελίδα δεν βρέθηκε.
Please enable ^ to view this page.
Please enable ^ in your browser.
Please turn on ^ and reload the page.
You need to enable ^ to run this app.
You must have ^ enabled to use this @.
Enable ^ to continue.
^ is required to view this @.
^ is disabled in your browser.
^ is turned off. Turn it on in your browser settings.
^ is blocked by your browser, so this content cannot be shown.
^ must be enabled to use this @.
It looks like ^ is disabled.
Your browser does not support ^.
Your browser has ^ turned off.
This @ requires ^.
This @ needs ^ to work.
This @ relies on ^ to work properly.
This @ works best with ^ enabled.
The @ does not work without ^.
The @ will not load because ^ is disabled.
The @ cannot start: ^ is blocked.
Without ^ this @ stays empty.
We're sorry but this @ doesn't work properly without ^ enabled. Please enable it to continue.
For full functionality of this @ it is necessary to enable ^. Here are the instructions how to enable it in your web browser.
noscript: please enable ^
To use this @, allow ^ in the settings of your browser.
Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite anzuzeigen.
JavaScript ist deaktiviert. Diese Seite benötigt JavaScript.
Veuillez activer JavaScript dans votre navigateur pour afficher cette page.
JavaScript est désactivé. Ce site nécessite JavaScript.
Por favor, active JavaScript en su navegador para ver esta página.
JavaScript está desactivado. Este sitio necesita JavaScript.
Attivare JavaScript nel browser per visualizzare questa pagina.
JavaScript è disattivato. Questo sito richiede JavaScript.
Si us plau, activeu JavaScript per veure aquesta pàgina.
Ative o JavaScript no seu navegador para ver esta página.
Schakel JavaScript in om deze pagina te bekijken.
"""
#: The usual mock Latin, in the public domain.
MOCK = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam.
Eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores.
Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora.
Quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur.
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti.
Nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit quo minus id quod maxime placeat facere possimus.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.
Curabitur pretium tincidunt lacus. Nulla gravida orci a odio. Nullam varius, turpis et commodo pharetra.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.
Praesent dapibus, neque id cursus faucibus, tortor neque egestas augue, eu vulputate magna eros eu erat.
Aliquam erat volutpat. Nam dui mi, tincidunt quis, accumsan porttitor, facilisis luctus, metus.
Donec nec justo eget felis facilisis fermentum. Aliquam porttitor mauris sit amet orci. Aenean dignissim pellentesque felis.
Cras ultricies ligula sed magna dictum porta. Proin eget tortor risus. Vivamus suscipit tortor eget felis porttitor volutpat.
Mauris blandit aliquet elit, eget tincidunt nibh pulvinar a. Quisque velit nisi, pretium ut lacinia in, elementum id enim.
"""
#: Sentences of mock Latin that are shuffled from its words, as its generators do, and the words of each.
SHUFFLED, WORDS = 800, 12
#: What page builders put where text will be.
FILLER = """
This is placeholder text.
This is sample text.
This is dummy text.
This is a dummy ~; replace it with your own.
This is an example ~. Edit or delete it.
This is a placeholder for the ~.
Placeholder for the ~
Placeholder text for the ~, to be replaced.
Placeholder ~.
Placeholder paragraph.
Sample ~.
Example ~.
Dummy ~.
Dummy text, please replace before publishing.
Replace this text with your own.
Replace this ~ before going live.
Your ~ here.
Your ~ goes here.
Your text goes here.
Your content goes here.
The ~ goes here.
The ~ will appear here.
The ~ will be added here later.
Here goes the ~.
Here comes the ~.
Text goes here.
~ goes in this space.
Insert your ~ here.
Insert ~ here.
Enter your ~ here.
Enter ~ here.
Type your ~ here.
Write your ~ here.
Add your ~ here.
Add a short ~ here.
Add a ~.
Click here to edit this ~.
Click here to add text.
Click to add ~
Double-click to edit.
Edit this ~.
Edit me.
~ coming soon.
Coming soon.
More content coming soon.
More information to follow.
Text to follow.
~ to follow.
~ to be added.
~ to be written.
To be written.
To be completed.
To be announced.
To be confirmed.
Content to be added.
TODO: add ~
TODO: write ~
TODO
TBD
TBA
N/A yet, fill in later.
Fill in the ~ later.
real ~ will go here later
xxx xxx xxx
xxxx xxxxxxx xx xxx
XXXXX
asdf asdf asdf
asdfasdf qwerty
qwerty qwerty
test test test
testing 123 test
foo bar baz
blah blah blah
bla bla bla
filler text filler text
The quick brown fox jumps over the lazy dog.
Blindtext. Dies ist ein Blindtext.
Dies ist ein Platzhalter für die Beschreibung.
Platzhaltertext. Hier steht ein Platzhalter.
Hier steht später Ihr Text.
Hier folgt in Kürze der Text.
Hier entsteht ein neuer Inhalt.
Mustertext, bitte durch eigenen Text ersetzen.
Ihr Text hier.
Text folgt.
Texte de remplissage.
Ceci est un faux texte.
Faux texte à remplacer.
Texte provisoire.
Texte à venir. Contenu à venir.
Votre texte ici.
Ici figurera le texte. Ici viendra la description.
Insérez votre texte ici.
À compléter.
Texto de relleno. Texto de ejemplo.
Este es un texto de relleno.
Texto de muestra, reemplazar antes de publicar.
Texto provisional que debe sustituirse.
Aquí va su texto. Aquí irá el contenido.
Escriba aquí su texto.
Próximamente. Pendiente de redactar.
Testo segnaposto. Testo di esempio.
Questo è un testo segnaposto.
Testo provvisorio da sostituire.
Qui va il testo. Qui andrà la descrizione.
Inserire qui il testo.
Prossimamente. Da completare.
Text de mostra. Aquí va el text.
Texto de exemplo. Insira aqui o seu texto.
Voorbeeldtekst. Hier komt uw tekst.
Hic ponatur textus. Textus addendus.
Your headline here. Your headline goes here.
This headline is a placeholder until the final copy arrives.
Dummy copy. Dummy content for the layout.
This is only dummy text to show the layout.
Copy to come. Copy goes here.
Write a catchy ~ here.
Say something about yourself here.
Use this space to tell visitors about yourself.
Tell your visitors more about this ~.
Describe the ~ here.
Describe your ~ in a few words.
This ~ is an example; write your own.
This ~ has not been written yet.
The ~ has not been added yet.
No ~ yet. No ~ available.
~ pending. ~ missing. ~ needed.
Still to be written: ~
Don't forget to replace the ~.
Remember to change this ~ before publishing.
Change this text. Change me. Replace me. Update me.
Delete this paragraph and write your own.
Please fill in. Please complete.
Under construction. This section is under construction.
Text folgt in Kürze. Inhalt folgt. Inhalt folgt später.
Wird noch ergänzt. Der Text wird noch ergänzt. Noch zu schreiben.
Beispieltext, bitte anpassen. Bitte ersetzen Sie diesen Text.
Fügen Sie hier Ihren Text ein. Titel hier eingeben.
Beschreibung fehlt noch.
Exemple de texte à remplacer. Ceci est un exemple, remplacez ce texte par le vôtre.
Le texte sera ajouté plus tard. Texte à compléter.
Ajoutez ici une description. Saisissez votre titre ici.
Bientôt disponible. En cours de rédaction.
Texto de ejemplo, cámbielo por el suyo. Este párrafo es un ejemplo.
Añada aquí una descripción. Escriba un título aquí.
Contenido pendiente. Texto por completar.
Testo di esempio, da sostituire con il proprio. Questo paragrafo è un esempio.
Aggiungere qui una descrizione. Scrivere qui il titolo.
Contenuto in arrivo. Testo da completare.
"""
#: Prose that tells of such things, brackets of an edition, markup: none of it is residue.
NATURAL = """
The old reading room asked for scripts that my browser would not run, therefore I ordered prints.
Since the site demanded JavaScript, the archivist mailed us scans on a disc.
He complained that the library's website never loaded on his telephone.
Two of the charters were not found when the chest was opened in 1890.
The letter was not found among the papers but between two boards of the cover.
The missing document turned up in another archive and was returned the following spring.
The file could no longer be found after the fire of 1731, as the inventory says.
The resource that the abbey relied on was the fishery.
The chapter denied him access to the archive until he had paid his debt.
Entry to the crypt was forbidden to women, as a chronicler reports.
The request was refused by the bishop and granted by the pope.
The servers in the hall were paid with bread and ale.
An internal quarrel at the gateway of the town delayed the service.
An error in the numbering means that folio 40 occurs twice.
The error on the last page was corrected by a later reader.
Most errors that the server recorded were confusions of similar letters.
The word dolor in the margin is a gloss on the verse.
The scribe wrote ipsum for ipsam and corrected himself.
The lorem that stands on the flyleaf is a misspelling of laurem.
The template calls the variable `{{name}}`, which the program fills in for each letter.
In older files the variable was written `${name}`; we now use a column instead.
The format string `%s` prints the name of the author.
A line filler at the end of the verse is ornamental.
Filler strokes complete the short lines of the column.
The text is to be continued on the next leaf.
The sample consists of twelve leaves chosen at random.
The description of the binding was written by the previous owner.
The placeholder was left blank by the printer for a painted initial.
Space was left here for an initial that was never painted.
{sic} (sic) [sic] [...] [illegible] [lost] [1] [12] [cf. p. 30] [see note] [in pencil] [erased] [later hand] [two words lost] [gap of three lines] [blank leaf] [left margin] {abbr} {ends} {f. 3v} {12} ⟨e⟩ ⟦a⟧ [a]men [12r] [recte 1451] [?] [!]
<p> </p> <br> <br/> <div> </div> <span> <b> </b> <i> <em> <li> <ul> <td> <tr> <table> <h1> </h1> <pb/> <lb/> <hi> <note> <add> <del> <http://example.org> <me@example.org> <|endoftext|> <s> </s> <pad> <unk>
The rate fell by 12 % in spring. It rose 5 % since then. A note costs $5 and a print $12, see #3 and #12.
"""
#: Opening and closing delimiters of template languages and page builders; strong ones stand for nothing else.
STRONG = (("{{", "}}"), ("{{ ", " }}"), ("{{{", "}}}"), ("${", "}"), ("#{", "}"), ("{%", "%}"), ("{% ", " %}"), ("<%=", "%>"), ("<%= ", " %>"), ("<% ", " %>"), ("[[", "]]"), ("[[ ", " ]]"), ("<<", ">>"), ("@@", "@@"), ("__", "__"), ("%%", "%%"), ("##", "##"), ("%(", ")s"))
WEAK = (("[", "]"), ("{", "}"), ("<", ">"), ("$", "$"), ("%", "%"))
BRACKET_FORMS = ("insert {f} here", "insert {f}", "enter {f} here", "enter {f}", "add {f} here", "add {f}", "your {f} here", "your {f}", "{f} here", "{f} goes here", "{f} to be added", "{f} to be supplied", "{f} tbd", "todo: {f}", "put {f} here", "to be completed", "to be added", "to be written", "to be filled in", "tbd", "todo", "tba", "fill in {f}", "select {f}", "choose {f}")
PRINTF = ("%s", "%d", "%s – %s", "%s, %s", "%d of %d", "%1$s", "%2$d", "Dear %s,", "%s %s", "{0}", "{1}", "{0} – {1}", "{0}, {1}", "{0} of {1}", "[0]{0}")


def spellings(field: str) -> list[str]:
    """A field's name as templates spell it."""
    words = field.split()
    camel = words[0] + "".join(w.capitalize() for w in words[1:])
    return list(dict.fromkeys([field, "_".join(words), "-".join(words), camel, camel[0].upper() + camel[1:], field.upper(), "_".join(words).upper(), field.title(), "item." + "_".join(words), "page." + camel]))


def _filled(block: str, things: tuple[str, ...] = THINGS) -> list[list[str]]:
    """One list for each phrase: its forms with every filling."""
    out = []
    for phrase in block.strip().splitlines():
        sides = [things if "~" in phrase else ("",), SCRIPTS if "^" in phrase else ("",), APPS if "@" in phrase and "me@" not in phrase else ("",)]
        forms = []
        for thing, script, app in product(*sides):
            x = phrase.replace("~", thing).replace("^", script)
            forms.append(x.replace("@", app) if app else x)
        out.append(forms)
    return out


def seeds(kind: str) -> list[list[str]]:
    """The seed phrases of a kind (placeholder, filler, mock, notice, natural): a list of forms for each."""
    if kind == "filler":
        return _filled(FILLER, (*CONTENTS, *(f"{c} of the {o}" for c in CONTENTS for o in OWNERS)))
    if kind == "mock":
        words = MOCK.lower().replace(",", "").replace(".", "").split()
        first = words[: words.index("sed", words.index("laborum"))]  # the oldest passage is the one that is used most
        draw = random.Random(2027)
        return _filled(MOCK) + [[" ".join(draw.choice(pool) for _ in range(WORDS)) + "." for _ in range(SHUFFLED)] for pool in (words, first)]
    if kind == "natural":
        return _filled(NATURAL)
    if kind == "notice":
        return _filled(NOTICES) + [[f.format(c=c, r=r) for c, r in STATUS.items()] for f in STATUS_FORMS]
    out = [[a + x + b for f in FIELDS for x in spellings(f)] for a, b in (*STRONG, *WEAK)]
    out += [[a + x + b for f in FIELDS for x in (form.format(f=f), form.format(f=f).upper())] for form in BRACKET_FORMS for a, b in WEAK[:3]]
    return out + [[p] for p in PRINTF]
