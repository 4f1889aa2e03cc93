"""Articles outside <article> in languages and scripts whose function words are not listed."""

import pytest

from quillstone.llm import html_main_text as H

TEXTS = {
    "ru": "В прошлом году город принял новый план развития, и теперь жители могут видеть первые итоги этой работы на улицах и в парках. Улицы стали шире, деревья высажены вдоль всех дорог, а у реки появились новые скамейки и дорожки для прогулок.",
    "it": "Nel corso degli ultimi anni la città ha cambiato volto e i suoi abitanti hanno visto nascere nuove piazze, giardini e percorsi lungo il fiume. Il progetto di riqualificazione, avviato con fondi pubblici, ha portato alberi e panchine in ogni quartiere.",
    "pl": "W ubiegłym roku miasto przyjęło nowy plan rozwoju i teraz mieszkańcy mogą zobaczyć pierwsze wyniki tej pracy na ulicach i w parkach. Drzewa rosną wzdłuż dróg, a nad rzeką powstały nowe ławki oraz ścieżki do spacerów dla całych rodzin.",
    "zh": "去年这座城市通过了新的发展规划，如今居民们可以在街道和公园里看到第一批成果。道路变宽了，沿途种满了树木，河边新建了长椅和步道，孩子们每天放学后都在那里玩耍，老人们则坐在树荫下聊天下棋，生活比以前舒适了许多。",
    "en": "Last year the town adopted a new plan and now people can see the first results of this work in the streets and in the parks. The roads have become wider, there are trees along all of them, and by the river there are new benches and paths for walking.",
}


@pytest.mark.parametrize("language", TEXTS)
def test_articles_in_plain_containers_come_out_whole(language):
    t = TEXTS[language]
    paragraphs = [t, t[: len(t) // 4].strip(), t]
    page = "<html><body><div class='nav'><a href=x>Home</a> <a href=y>About</a></div><div id=content><h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div><div class=footer>Copyright 2020</div></body></html>"
    assert H.main_text(page) == "\n\n".join(["Title", *paragraphs])
    assert H.main_text(page.replace("<div id=content>", "<article>").replace("</div><div class=footer>", "</article><div class=footer>")) == "\n\n".join(["Title", *paragraphs])


def test_a_listed_language_in_a_notice_does_not_hide_another_script():
    notice = "<div>This site uses cookies and it is for the better experience of all that are here, and by the use of it you agree to that.</div>"
    page = f"<html><body>{notice}<div><p>{TEXTS['ru']}</p><p>{TEXTS['ru']}</p></div></body></html>"
    assert H.main_text(page).count(TEXTS["ru"]) == 2


def test_a_short_paragraph_alone_is_kept():
    assert H.main_text("<html><body><div><p>A short note about one thing.</p></div><div><a href=x>Home</a></div></body></html>") == "A short note about one thing."
    assert H.main_text("<html><body><div class=sidebar><p>A short note.</p></div></body></html>") == ""
