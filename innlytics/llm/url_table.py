"""A labelled table of URLs (1: block), the default training table of the URL
filter. Any table (url, label) may take its place.

Names and paths are written by hand after kinds of sites known from the web
(a match with a real site is chance); nothing is taken from pages that the
filter is used on. Blocked names are of pharmacy, gambling, adult, pirated,
loan, counterfeit, phishing, link and advertising sites. Ordinary ones are of
many kinds and languages, also brand names without a meaning and names that
hold pieces of blocked ones (a farm, a specialist, Essex).
"""

BLOCKED = """
cheap-meds discount-pills pillsonline best-pharmacy-deals buyviagra cialis-generic rx-no-prescription weightloss-pills
miracle-diet-pill genericmeds24 cheapviagra4u tramadol-overnight steroids-shop male-enhancement-pills canadian-pills-rx
casino-royal freeslots poker-bonus winbigjackpot online-casino-777 luckyslots24 bet-and-win roulette-strategy
casinobonus jackpot-spins vegas-slots-free sportsbet-tips blackjack-cash bingo-win-money mega-casino spin2win
adult-cams xxx-videos sexy-singles hotadultchat livesexcams nude-girls escorts-tonight milf-dates xxxtube
porn-free-hd sexdating hookup-now cam-girls-live erotic-video adultfriend-chat
warez-downloads freekeygen crack-serials torrent-warez cracked-software full-movie-free-download nulled-scripts
free-mp3-download-full game-cracks serialkeys moviez-torrent activator-kms pirate-streams hack-tool-free
payday-loan-cheap cheap-loans instantloans bad-credit-loan-now fast-cash-advance debt-relief-now quick-payday
no-credit-check-loans easy-cash-today forex-profit crypto-doubler bitcoin-giveaway earn-money-fast make-money-home
get-rich-quick work-from-home-cash binary-options-win million-dollar-secret passive-income-hack free-money-now
replica-watches fake-rolex-sale cheap-handbags-outlet replicabags louis-outlet-cheap cheapjerseys-sale ray-outlet-sale
discount-rolex knockoff-shoes wholesale-replica
verify-account-login secure-paypal-update bank-login-verify appleid-confirm phishing-login account-suspended-alert
webmail-update-verify claim-your-prize you-have-won free-iphone-winner gift-card-generator prize-winner-now
malware-free-download pc-cleaner-alert virus-warning-fix fix-your-pc-now toolbar-install driver-update-free
link-farm spam-links seospam buy-backlinks cheap-seo-links link-exchange-seo content-spinner article-spam
guestbook-spam bulk-email-lists spam-mailer buy-followers cheap-likes traffic-bot autoblog-network pbn-links
spamdirectory free-link-directory doorway-pages keyword-stuffing expired-domains-links
ad-tracker ads-click banner-track popunder-ads adserver-network click-ads-money tracking-pixel adclicks popup-ads
affiliate-offers-now clickbait-money viral-clickbait shocking-trick-doctors-hate
""".split()

ORDINARY = """
river-museum citylibrary garden-notes compilerdocs university-hall valley-herald weather-station cooking-school
mountain-club thinkersdesk open-data theatre-royal bicycle-repair letters-archive music-teacher linux-users chess-club
town-council schoolbooks hospital-trust railway-timetable harbour-festival birdwatchers astronomy-society pottery-studio
bread-and-salt family-recipes hikingtrails lakeside-hotel grandhotel oldmill-inn seaview-guesthouse northern-cathedral
essex-cricket sussex-downs middlesex-records specialist-clinic socialist-history analysis-group therapist-register
hill-farm farmers-market dairyfarm windsor-castle winter-gardens linkedlists weblinks-institute cashmere-wool
freehold-law free-software-society freetown-tourism billiards-hall pillow-makers pharmacology-review pharmacy-school
cheapside-history casinoarchitecture loan-library museum-loans adsorption-lab adastra download-manuals trackandfield
racetrack cyclepath bannerman-house clickstream-research watchmakers-guild shoemaker jewellery-museum bank-of-stones
securityadvisories loginradius-docs money-museum rich-pastures quickstep-dance fastfood-history videolectures
bibliothek-neustadt stadtwerke gemeinde-waldau schwimmverein buchhandlung-linden wetterdienst handwerkskammer
kinderarzt-praxis mairie-belval boulangerie-dupre lycee-montclair journal-des-arts randonnee-alpes musee-textile
theatre-du-lac ayuntamiento-rioalto colegio-sanmartin noticias-del-valle recetasdecasa biblioteca-comunale
comune-pietralta ricette-nonna perpustakaan-kota wisata-danau sekolah-harapan koperasi-tani gemeente-veendam
fietsersbond bakkerij-molen kommune-nordvik skolebiblioteket kirjasto-lahti urzad-gminy szkola-muzyczna
knihovna-mesto konyvtar-varos belediye-kultur hastane-rehberi sakura-ryokan toshokan-kita hanok-stay
zorvia quintel lumora bexley-partners talwind korrigan oprea-studio nimbral vastera delphon marrowby ithaca-press
kestrelsoft ondine aldermoor brantic solvane tresco ulverstone wexcombe yarrowby elmhurst greymoor hollins
thornbury atherton rotherham northern-line others-and-others leanderthal ingleton strathearn whitestone sheridan
a11y-notes 3dprinting-wiki route66-diner web2-history studio54-photos math101 h2o-research team42 p2p-papers
""".split()

#: Word pairs of each kind: every first word meets every second one.
BLOCKED_PAIRS = (
    ("cheap discount generic online buy", "pills meds viagra cialis pharmacy tablets antibiotics"),
    ("free lucky vegas royal online win", "casino slots poker jackpot roulette betting bingo"),
    ("adult live hot sexy free nude", "cams sex xxx dating porn singles escorts"),
    ("free full crack download game", "warez keygen torrent serials cracked activator"),
    ("payday instant cash easy fast", "loans loan money credit profit advance"),
    ("cheap fake discount outlet", "rolex replica handbags watches jerseys"),
    ("secure verify account bank paypal", "login verify update alert suspended"),
    ("win claim free you-won", "prize iphone giveaway gift-card winner"),
    ("spam buy cheap seo bulk", "links backlinks followers likes farm directory blog email"),
    ("spam link content splog scraper webspam", "ring hub blast sites pages host offers farms"),
    ("ads click pop banner", "tracker click ads tracking server network"),
)
ORDINARY_PAIRS = (
    ("river city county northern old", "museum library council archive records school"),
    ("garden quiet family harvest village", "kitchen recipes bakery market orchard dairy"),
    ("mountain lake forest harbour coastal", "hotel trails club tours sailing weather"),
    ("physics chemistry history applied ocean", "lab department journal lectures institute"),
    ("morning valley harbour daily evening", "herald news times gazette radio"),
    ("open quick native simple small", "parser compiler database docs toolkit"),
    ("saint general children dental", "hospital clinic surgery care medicine"),
    ("royal chamber folk modern", "theatre orchestra gallery choir dance"),
    ("cricket chess tennis cycling", "club league society union fixtures"),
    ("stadt neue alte sankt", "bibliothek schule verein kirche werke"),
    ("petit grand jardin maison", "musee ecole marche cuisine lac"),
    ("casa nueva verde costa", "escuela noticias jardin playa biblioteca"),
    ("steel timber copper glass stone", "works builders supplies design studio engineering"),
    ("green solar clean wind", "energy power homes cooperative planning"),
    ("regional national public state", "health parks transport statistics education court"),
    ("young senior women student", "writers volunteers athletes network forum"),
    ("coffee tea wine cheese pasta", "roasters cellar house tasting guide"),
    ("red blue silver amber", "fox heron oak bridge anchor lantern"),
    ("software cloud mobile secure", "testing consulting reviews hosting developers"),
    ("vintage classic model electric", "cars trains radios guitars tractors"),
    ("wild native tropical alpine", "flowers birds orchids butterflies mushrooms"),
    ("east west south upper", "gate brook minster stead thorpe mouth"),
    ("world travel island desert", "maps diary photos ferries archaeology"),
    ("mein unser das freie", "haus theater wetter dorf rathaus radio"),
    ("portal banco prefeitura jornal", "norte central cidade serra"),
    ("the our my their", "garden bakery reader workshop horse herald journal teacher"),
    ("rhein main donau elbe", "tal hafen zeitung museum"),
    ("thorn wex lan mar bel", "field dale ham wick ora tis"),
)


def _names(names: list[str], pairs: tuple) -> list[str]:
    """The names, and those of the pairs, joined with and without a hyphen."""
    out = list(names)
    for first, second in pairs:
        out += [f"{x}{'-' * ((i + j) % 2)}{y}" for i, x in enumerate(first.split()) for j, y in enumerate(second.split())]
    return out


#: Shapes that both labels take in turn, so that none of them tells the label.
SUBDOMAINS = ("", "www.", "", "blog.", "m.", "shop.", "news.", "en.", "forum.", "static.", "www2.")
ENDINGS = (".com", ".org", ".net", ".de", ".co.uk", ".info", ".fr", ".io", ".example.com", ".us", ".example.org", ".edu", ".eu",
           ".example.net", ".co.id", ".com.br", ".nl")
PATHS = (
    "", "/", "/index.html", "/en/{n}", "/{n}", "/2019/0{d}/1{d}/", "/about", "/de/{n}.html", "/article.php?id={n}", "/p/{n}/",
    "/category/page/{d}", "/fr/{n}/#top", "/search?q=a+b&page={d}", "/user/{n}/profile", "/files/doc-{n}.pdf", "/es/{n}",
    "/?utm_source=mail&utm_id={n}", "/contact-us", "/a/b/c/{n}.htm", "/img/{n}.jpg", "/tag/new?sort=asc", "/~home/{d}/",
    "/en-us/item/{n}-{d}", "/feed.xml", "/view.aspx?item={n}&lang=en", "/posts/{n}?ref=front", "/en/{d}/{n}.html")
#: Paths that belong to a label.
BLOCKED_PATHS = ("/buy/cheap-pills", "/bonus/casino", "/win/cash-now", "/free-download/crack.exe", "/xxx/live-cams",
                 "/payday-loans/apply", "/verify-account/login.php", "/replica/sale", "/seo/buy-backlinks", "/ads/click?track={n}")
ORDINARY_PATHS = ("/history/exhibits", "/catalog/authors", "/docs/manual/chapter-{d}", "/timetable/2021", "/recipes/soup",
                  "/minutes/2020/may", "/lectures/physics-{d}", "/local/weather", "/essays/on-walking", "/visitors/opening-hours")


def rows() -> list[tuple[str, int]]:
    """Four URLs of every name in turning shapes, and one with a path of its label."""
    out = []
    for label, names, own in ((1, _names(BLOCKED, BLOCKED_PAIRS), BLOCKED_PATHS),
                              (0, _names(ORDINARY, ORDINARY_PAIRS), ORDINARY_PATHS)):
        for i, name in enumerate(names):
            for j in range(5):
                k = 5 * i + j
                path = own[i % len(own)] if j == 4 else PATHS[(4 * i + j) % len(PATHS)]
                out.append((f"http{'s' * (k % 3 > 0)}://{SUBDOMAINS[k % len(SUBDOMAINS)]}{name}{ENDINGS[k % len(ENDINGS)]}"
                            + path.format(n=(i * 137 + j * 61) % 2000, d=1 + k % 9), label))
    return out
