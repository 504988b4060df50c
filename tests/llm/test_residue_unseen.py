"""Pages in wordings that no list holds, in ten languages, among real pages."""

from test_residue import DOCS, TITLES

from reelgrid.llm.residue import residue

#: One page each of ten languages and of some machines, as sites word them.
PAGES = [
    "We're sorry but this app doesn't work properly without JavaScript enabled.", "Whoops, that page is gone. Our librarians are still looking for it.", "Die angeforderte Seite wurde leider nicht gefunden.", "Ihre Anfrage konnte wegen einer Störung nicht bearbeitet werden.",
    "Désolé, la page que vous cherchez est introuvable.", "Lo sentimos, la página que busca no existe.", "Siamo spiacenti, la pagina cercata non esiste più.", "Desculpe, a página que você procura não foi encontrada.", "De pagina die u zoekt bestaat niet meer.",
    "Strona, której szukasz, nie istnieje.", "Запрашиваемая страница не существует.", "お探しのページは見つかりませんでした。", "요청하신 페이지를 찾을 수 없습니다.", "Sidan du letar efter finns inte längre.", "Aradığınız sayfa bulunamadı.", "Η σελίδα που ζητήσατε δεν βρέθηκε.",
    "Sivua ei löytynyt. Tarkista osoite.", "ไม่พบหน้าที่คุณต้องการ", "The gremlins are in the engine room again; our people chase them out with brooms.",
    "Exception in thread main\n" + "\n".join(f"at org.site.web.Page.step{k}(Page.java:{k})" for k in range(50)),
]
#: The same kind of page without any furniture and in a single copy, where only its own words can tell.
ALONE = [
    "Page not found", "Error 404", "HTTP ERROR 503", "Internal Server Error", "This site requires JavaScript.", "Pagina non trovata", "お探しのページは見つかりませんでした", "Die angeforderte Seite wurde nicht gefunden.", "Lo sentimos, la página que busca no existe.", "Запрашиваемая страница не найдена.",
    "De pagina is niet gevonden.", "A página não foi encontrada.", "Please turn JavaScript on and reload the page.", "Coming soon", "Your content goes here.", "Lorem ipsum dolor sit amet.", "Dear <FirstName>, welcome", "Access to this resource is forbidden.", "Service unavailable - try again later", "Connection timed out",
    'TypeError: Cannot read properties of undefined\n    at render (app.js:10:5)\n' + "\n".join(f"    at step{k} (app.js:{k}:1)" for k in range(50)),
]
WORDS = "river letter bridge garden winter engine market candle".split()


def test_unseen_pages_by_hosts_and_real_pages_kept(spark):
    rows, k = [], 0
    for page in PAGES:
        for copy in range(6):
            rows.append((k, f"<h1>Film number {copy}</h1>\n{page}\nReference: 9f{k:06}", f"s{copy % 3}", f"tt{copy}", ""))
            k += 1
    last = k
    for copy in range(200):  # real pages under the same furniture, and copies of one real page of one title
        said = f"The {WORDS[copy % 8]} of {WORDS[copy // 8 % 8]} opens in year {copy}, and {WORDS[copy // 3 % 8]} number {copy * 7} is sold to Ann{copy} by night."
        rows.append((k, f"<h1>Film number {min(copy, 190)}</h1>\n{said if copy < 190 else 'A quiet evening of Film number 190 by the river.'}\nReference: 9f{k:06}", f"s{copy % 3}", f"tt{min(copy, 190)}", ""))
        k += 1
    titles = spark.createDataFrame([(f"tt{c}", f"Film number {c}") for c in range(200)], TITLES)
    got = {r["doc_id"]: r["evidence"] for r in residue(spark.createDataFrame(rows, DOCS), titles).collect()}
    found = [i for i in range(last) if i in got]
    assert len(found) >= 0.95 * last and sum(got[i] == "recurring" for i in found) >= 0.9 * last
    assert [rows[i][1] for i in got if i >= last] == []


def test_unseen_pages_alone(spark):
    data = [(k, t, f"s{k % 3}", None, "") for k, t in enumerate(ALONE)]
    got = {r["doc_id"] for r in residue(spark.createDataFrame(data, DOCS), spark.createDataFrame([], TITLES)).collect()}
    assert len(got) >= 0.9 * len(ALONE), [ALONE[k] for k in range(len(ALONE)) if k not in got]
