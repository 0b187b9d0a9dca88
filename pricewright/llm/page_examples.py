"""A small labelled table of web pages, written for this library. A block whose element carries
``data-main`` belongs to the main text, every other block does not."""

PAGES = [
    """<html><head><title>Storm over the bay</title></head><body><header><a href="/">Harbour Post</a><p>News since 1901</p></header>
    <nav><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/weather">Weather</a></li></ul></nav>
    <article><h1 data-main>Storm over the bay</h1><p data-main>A storm crossed the bay on Monday night and tore the roofs from two sheds at the old quay, the harbour master said.</p>
    <p data-main>No one was hurt.</p><p data-main>Boats had been moved into the inner basin the day before, after <a href="/w">a warning</a> from the weather office, and the ferry did not sail until noon.</p>
    <h2 data-main>What comes next</h2><ul><li data-main>Calm until Thursday</li><li data-main>Rain at the weekend</li></ul>
    <div class="ad">Buy one pair of boots and get a second pair for half the price at every shop in town this week.</div>
    <p data-main>The quay opens again on Friday.</p></article>
    <aside><h3>Most read</h3><ul><li><a href="/1">Council votes on the bridge</a></li><li><a href="/2">Ten walks for spring</a></li></ul></aside>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>We lost our fence as well, and the road by the mill was under water all night long.</p></div><div class="comment"><p>Thanks!</p></div>
    <form><label>Your name</label><textarea>Say something</textarea><button>Send</button></form></section>
    <footer><p>&copy; Harbour Post. All rights reserved. Printed and published by the Harbour Post company, Quay Street 4.</p></footer></body></html>""",
    """<html><body><div id="header"><a href="/">Home</a> | <a href="/about">About</a> | <a href="/contact">Contact</a></div>
    <div class="cookie-notice">This site uses cookies to remember what you have read. By going on you agree to this. <a href="/c">More</a></div>
    <div class="content"><h1 data-main>How to keep bees in a small garden</h1><p data-main>Bees need water, shelter from the wind and flowers from March to October. A hive can stand on a flat roof if it is shaded.</p>
    <p data-main>Start with one hive.</p><blockquote data-main>A quiet hive is a healthy hive.</blockquote><p data-main>Look after them every ten days in spring, and leave them alone once it grows cold; they know better than we do how to pass the winter.</p>
    <table><tr><td data-main>Month</td><td data-main>Work</td></tr><tr><td data-main>April</td><td data-main>Check for food</td></tr></table></div>
    <div class="sidebar"><p>Our newsletter comes once a month and brings news from the garden, seeds to swap and dates of meetings near you.</p><form><input value="x"><button>Join</button></form></div>
    <div class="footer"><p>Imprint</p><a href="/p">Privacy</a></div></body></html>""",
    """<html><body><div class="menu"><a href="/a">Alle Themen</a><a href="/b">Politik</a><a href="/c">Kultur</a></div>
    <main><header><h1 data-main>Die Mühle am Fluss</h1><p data-main>Ein Bericht</p></header><p data-main>Seit dreihundert Jahren dreht sich das Rad der Mühle, und noch immer mahlt der Müller das Korn der Höfe ringsum zu Mehl.</p>
    <p data-main>Er ist der Letzte.</p><figure><figcaption data-main>Das Rad im Winter</figcaption></figure><p data-main>Sein Sohn lernt in der Stadt einen anderen Beruf und kommt nur noch zum Fest der Ernte heim.</p>
    <div class="share"><a href="/f">Teilen</a></div><div class="advert"><p>Jetzt neu: Brot nach alter Art, gebacken in der Nacht, geliefert am Morgen, frei Haus in der ganzen Stadt.</p></div></main>
    <div class="related"><h2>Mehr zum Thema</h2><p><a href="/x">Das letzte Rad im Tal</a></p></div><footer>Impressum</footer></body></html>""",
    """<html><body><p><a href="/">Start</a> <a href="/list">List</a> <a href="/help">Help</a></p>
    <h1 data-main>Notes on the night train</h1><p data-main>The train leaves at nine and reaches the border at four in the morning, when the guards come through and look at everyone's papers without a word.</p>
    <p data-main>After that the hills begin and nobody sleeps, because the line bends and climbs and the cups slide along the little tables until the sun is up.</p>
    <p data-main>At eight there is tea, and bread, and the first houses of the town come into view below the line, white and very small.</p>
    <p><a href="/prev">Older</a> <a href="/next">Newer</a></p><p>Copyright</p></body></html>""",
    """<html><body><nav><a href="/es">Inicio</a></nav><div role="alert" class="notice"><p>El servicio estará parado el domingo por la noche para cambiar las máquinas; disculpen las molestias.</p></div>
    <article class="post"><header><h1 data-main>La casa del faro</h1></header><p data-main>La casa del faro tiene tres plantas y una escalera de piedra que sube hasta la luz.</p><p data-main>Nadie vive allí.</p><pre data-main>norte 12 sur 4</pre>
    <footer><p>Publicado en <a href="/v">Viajes</a></p></footer></article><article class="comment"><p>Yo estuve allí de niño con mis padres y me acuerdo muy bien del viento y de las gaviotas.</p></article>
    <aside><p>Lea también otras historias de la costa, escritas por nuestros lectores durante el verano pasado.</p></aside></body></html>""",
    """<html><body><div id="top-banner"><p>Summer sale: all lamps at half price until Sunday, in every shop and online, while they last.</p></div><ul class="breadcrumb"><li><a href="/">Home</a></li><li>Recipes</li></ul>
    <div id="main"><h1 data-main>Leek soup</h1><p data-main>Serves four.</p><ol><li data-main>Wash the leeks and cut them into rings.</li><li data-main>Boil them in salted water with two potatoes.</li><li data-main>Add cream and serve with bread that has been toasted in butter.</li></ol>
    <p data-main>See also <a href="/r/2">potato soup</a></p></div><div class="promo"><p>Try our new knives, made by hand in a small town and sharpened for free as long as you live.</p></div>
    <div class="comments"><p>Made this last night and the children asked for more, which has never happened before in this house.</p></div><form class="search"><p>Search this site</p><select><option>All</option><option>Soups</option></select></form></body></html>""",
    """<html><body class="has-sidebar"><ul class="menu"><li><a href="/1">One</a></li><li>Two</li></ul><article><h1 data-main>Links of the week</h1><p data-main><a href="/l1">A film about tides and the people who read them</a></p><p data-main><a href="/l2">Maps of rivers that are no more</a></p>
    <p data-main>Enjoy.</p></article></body></html>""",
    """<body><nav><a href="/">Up</a></nav><article><p data-main>Un mot.</p><p data-main><b>Autre</b></p><p data-main>Il pleut depuis dix jours sur la ville et les ponts du bas sont fermés aux voitures comme aux piétons.</p><div class="ad">Dix livres pour un euro.</div><p data-main>Fin.</p></article>""",
    """<html><body><p>Search</p><div class="story"><div class="story-header"><h1 data-main>The clock</h1></div><p data-main>The clock over the gate has stopped at ten past two.</p><p data-main><a href="/gate">The gate</a></p></div></body></html>""",
    """<html><body><h1 data-main>A plain page</h1><p data-main>It has no containers that say what they are, only a heading and some paragraphs of text, one after the other.</p><p data-main>That is enough for a reader, and it was how most pages were written in the first years.</p></body></html>""",
]
