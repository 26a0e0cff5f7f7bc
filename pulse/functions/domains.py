"""Publisher lookup tables."""

# Publisher group of each site.
DOMAIN_GROUPS = {
    "asiaone.com": "asiaone",
    "businesstimes.com.sg": "businesstimes",
    "channelnewsasia.com": "channelnewsasia",
    "cnalifestyle.channelnewsasia.com": "channelnewsasia",
    "cnaluxury.channelnewsasia.com": "channelnewsasia",
    "goodyfeed.com": "goodyfeed",
    "babelfish.mothership.sg": "mothership",
    "mothership.sg": "mothership",
    "mustsharenews.com": "mustsharenews",
    "ricemedia.co": "ricemedia",
    "straitstimes.com": "straitstimes",
    "stomp.straitstimes.com": "stomp",
    "tnp.straitstimes.com": "thenewpaper",
    "theonlinecitizen.com": "theonlinecitizen",
    "todayonline.com": "today",
    "sg.finance.yahoo.com": "yahoosingapore",
    "sg.news.yahoo.com": "yahoosingapore",
    "sg.style.yahoo.com": "yahoosingapore",
}

# Mean monthly visits and unique visitors of each group.
GROUP_TRAFFIC = {
    "asiaone": (4990000, 1290000),
    "businesstimes": (1630000, 622688),
    "channelnewsasia": (14760000, 2330000),
    "goodyfeed": (891376, 461731),
    "mothership": (6770000, 1660000),
    "mustsharenews": (2010000, 823526),
    "ricemedia": (148791, 86394),
    "straitstimes": (12310000, 2230000),
    "stomp": (1270000, 427113),
    "theindependent": (2370000, 683818),
    "thenewpaper": (707314, 350734),
    "theonlinecitizen": (657013, 233237),
    "today": (3660000, 1170000),
    "yahoosingapore": (5010000, 561434),
}
