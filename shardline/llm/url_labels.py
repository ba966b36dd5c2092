"""The labelled URL table of the URL filter: host, path, blocked.

Labelled by hand, by what a host's name says of its site; the names are made up, of the
kinds of sites that a filter is for (gambling, pills, loans, adult, spam, ads, malware).
The rules took no part, and no host of the pages is in it. Both classes stand under the
same subdomains, top domains and paths, so that these teach next to nothing.
"""

from __future__ import annotations

BLOCKED = """
casino-royal bestcasino online-casino casinobonus lucky-casino slots-vegas slotmachine jackpot-slots poker-room
pokerstar-club roulette-win bets-online bet-now sportsbet betting-tips freebet bigbets free-spins free-bonus win-big
win-cash win-prizes lottery-winner cheap-viagra pills-online buy-pills cheap-meds cheap-pharmacy discount-pills viagra-shop
diet-pills cheap-replica cheap-loans payday-loans quick-cash-loans adult-dating adult-video adultcams xxx-tube
xxx-movies porn-hd porn-free sex-chat sexcams hot-webcams escort-girls spam-mailer bulk-spam spamlinks link-farm
linkfarm-seo clickfarm content-farm ads-server adserver-pro ad-network tracker-ads click-track tracking-pixel popup-ads
adsclick banner-ads malware-download free-download-crack cracked-keygen warez-serial phishing-login
""".split()

ALLOWED = """
city-library university history-museum weather daily-news morning-post parliament health-ministry science-review
garden-notes cooking-school recipes kitchen-stories mountain-hikes railway-times travel-diary photo-journal
chess-club football-results tennis-league running-track farm-shop organic-farm farmers-market adventure-books bookshop
open-source linux-kernel python-docs database-guide math-lessons physics-forum chemistry-lab biology-notes
language-course grammar translation-office dictionary encyclopedia archive national-gallery theatre orchestra
concert-hall film-festival cinema radio-station television newspaper magazine poetry novels authors publisher
hospital dentist pharmacy-board family-doctor insurance savings-bank tax-office city-council town-hall fire-brigade
police elementary-school kindergarten teachers students research institute engineering architecture carpenter
bakery restaurant hotel-garden camping airport harbour bicycle-repair cars-weekly furniture textile-mill
water-works solar-energy recycling forest-service bird-watch fishing beekeeper veterinary horse-riding theology
""".split()

SUBDOMAINS = ("", "www.", "m.", "blog.")
DOMAINS = ("com", "net", "org", "example.com", "example.net", "example.org")
PATHS = ("/", "/en/4021", "/de/17", "/fr/905.html", "/es/3310/", "/index.html", "/en/about", "/de/news/8", "/fr/blog/21", "/es/p/6")


def rows() -> list[tuple[str, str, int]]:
    """Every name in a subdomain of each kind and with six paths or more of the list."""
    return [(f"{sub}{name}.{DOMAINS[(i + 5 * j + k) % len(DOMAINS)]}", PATHS[(3 * i + j + 4 * k) % len(PATHS)], blocked)
            for blocked, names in ((1, BLOCKED), (0, ALLOWED)) for i, name in enumerate(names)
            for j, sub in enumerate(SUBDOMAINS) for k in range(2)]
