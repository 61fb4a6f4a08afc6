"""The crawl record: one row a page, nested as extracted."""

CRAWL_SCHEMA = """ord long, url string, title string, description string, h1s array<string>, h2s array<string>, h3s array<string>,
images array<struct<src:string,alt:string>>, schemas array<string>, robots string, canonical string, canonical_status string,
hreflangs array<struct<href:string,hreflang:string>>,
internal_links array<struct<anchor_text:string,href:string,is_internal:boolean,rel:string,nofollow:boolean,sponsored:boolean,ugc:boolean>>,
social_tags array<struct<network:string,property:string,content:string>>, status string, status_code int, redirect_status_code int,
redirected_url string, redirect_type string, redirect_chain array<struct<url:string,status:int,type:string,status_text:string,source:string>>,
initial_url string, final_url string, hop_count int, last_modified string, fetch_time string"""
