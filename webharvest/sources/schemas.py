"""Explicit schemas of the document tables and messages (DDL)."""

ARTICLES = (
    "rid string, acid string, url string, title string, author string, pubtime bigint, content string, domain string, subdomain string, channel string, mediaType int, keyword string, status int, "
    "result map<string,string>, detail map<string,string>, crawlinfo struct<listMode:string,mode:string,stid:bigint,uid:bigint,pid:bigint,sid:bigint,tid:bigint,kid:bigint,listRule:bigint,list_url:string,list_crawl_id:bigint>, ctime bigint, utime bigint"
)
CRAWL_LOG = "uuid bigint, lid string, stid bigint, pid bigint, sid bigint, tid bigint, uid bigint, kid bigint, rid bigint, mode string, frequency string, crawl_urls map<string,string>, crawl_start bigint, crawl_end bigint, total bigint, new_count bigint, repeat_count bigint, page bigint, repeat_page bigint, errid string, ctime bigint"
ERROR_LOG = "uuid bigint, lid string, tid bigint, mode string, frequency string, url string, error string, msg string, class string, create_at bigint"
KEYWORDS = "uuid bigint, word string, tid bigint, status int, frequency string, expire bigint, src string, ctime bigint, utime bigint"
LIST_RULE = "uuid bigint, preid bigint, type int, name string, domain string, subdomain string, mediaType int, frequency string, request map<string,string>, paging map<string,string>, parse map<string,string>, `unique` map<string,string>, status int, ctime bigint, utime bigint"
DETAIL_RULE = "uuid bigint, name string, domain string, subdomain string, urlPattern string, ruleName string, mediaType int, request map<string,string>, paging map<string,string>, parse map<string,string>, `unique` map<string,string>, status int"
MEDIA_TYPES = "name string, domain string, subdomain string, mediaType int, status int"
PROJECTS = "uuid bigint, name string, status int, ctime bigint, utime bigint"
SITES = "uuid bigint, pid bigint, name string, status int, ctime bigint, utime bigint"
TASK = "uuid bigint, pid bigint, sid bigint, type string, frequency string, name string, status int, ctime bigint, utime bigint"
URLS = "uuid bigint, pid bigint, sid bigint, tid bigint, url string, jsonUrl string, ruleId bigint, ruleStatus int, expire bigint, status int, ctime bigint, utime bigint"
SPIDER_TASK = "uuid bigint, mode string, pid bigint, sid bigint, tid bigint, uid bigint, kid bigint, rid bigint, parentid string, url string, frequency string, status int, expire bigint, plantime bigint, crawltime bigint, crawlinfo map<string,string>, save map<string,string>, ctime bigint, utime bigint"
UNIQUE = "unid string, ctime bigint"
MESSAGE = "mode string, type string, item bigint, status int, frequency string, expire bigint, pid bigint, sid bigint, rid string, tid bigint, kid bigint, uid bigint, mediaType int, seq bigint"

TABLES = {name.lower(): value for name, value in dict(globals()).items() if name.isupper() and isinstance(value, str)}
