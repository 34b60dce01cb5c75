"""URLs of the URL filter's held-out test, written by hand and not trained on."""

BLOCK = """
http://cheap-antibiotics-rx.net/order https://www.pharma-discount24.com/viagra-100mg http://pillstore.info/en/441
https://buy-ambien-online.org/ http://slots-jackpot-win.com/spin https://casino-vip-club.net/fr/88.html
http://pokerstars-free-cash.info/bonus https://betting-casino.co.uk/2020/05/12/ http://m.roulette-win.org/en/19
http://sexcams-hd.com/live https://xxx-amateur-tube.net/watch?v=12 http://adult-singles-chat.org/join https://nudecams.eu/7
http://keygen-warez.net/full.zip https://crackedgames-torrent.com/download http://free-serial-crack.info/win10
https://payday-cash-loans.us/apply http://instant-loan-approval.net/en/3 https://earn-cash-online-fast.com/offer
http://bitcoin-doubler-profit.io/start https://replica-rolex-outlet.com/sale http://cheap-replica-handbags.net/de/12
http://paypal-account-verify.com/login.php https://secure-login-update.info/verify http://you-won-free-iphone.com/claim
https://spamlinks-directory.org/page/4 http://buy-seo-backlinks.com/ https://linkfarm-network.net/en/601
http://ads-banner-click.com/track?id=9 https://adclick-tracker.net/px.gif http://free-followers-likes.com/insta
https://email-spam-tools.net/bulk http://popads-network.info/serve https://clickbait-viral-tricks.com/2021/
""".split()

ALLOW = """
https://www.county-records.org/deeds/1843 http://physics.northfield.edu/people/ https://blog.quiet-kitchen.com/2018/11/plum-cake
http://stadtbibliothek-auen.de/oeffnungszeiten https://mediatheque-rivage.fr/agenda http://escuela-olmos.es/matricula
https://kota-lama.co.id/wisata/12 http://gymnasium-ost.example.org/de/31 https://docs.parserkit.io/en/latest/install.html
http://forum.telescope-makers.net/viewtopic.php?t=882 https://village-cinema.co.uk/whats-on http://oceanography.info/tides/7
https://meadow-vets.com/ https://news.harbour-times.com/local/bridge-reopens-after-repairs http://m.tramways.nl/lijn/5
https://lavendula.com/en/204 http://perrinholt.net/8 https://www.ostravia.eu/team http://kalmeric.org/posts/77?ref=front
https://essex-wildlife.org.uk/reserves http://farmstead-cheese.com/shop/cheddar https://analytical-chemist.net/papers/55.pdf
http://winchester-choir.org/concerts https://linkoping-orienteering.se/karta http://adsum-alumni.edu/class-of-1999
https://freeport-ferries.com/timetable http://watchtower-ruins.example.net/en/611 https://securities-law.info/cases/2004
http://tennis-club-moor.co.uk/fixtures https://maps.ridgewalks.com/route/41.gpx http://cardiology-unit.example.com/visitors
https://wiki.typesetting.org/index.php?title=Kerning http://bakery-am-markt.de/brot https://violin-makers.eu/en/12
""".split()
