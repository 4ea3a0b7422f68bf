"""Column types of records and of what is derived from them (DDL)."""

from __future__ import annotations

#: A frontmatter entry: place, key, kind of the value, canonical JSON, its text (strings and scalars), items of an array.
ENTRY = "struct<pos:int,key:string,kind:string,json:string,text:string,items:array<string>>"
ENTRIES = f"array<{ENTRY}>"
FRONTMATTER = f"struct<json:string,entries:{ENTRIES},error:string>"
HEADING = "struct<idx:int,level:int,text:string,line:int,parent_idx:int,end_line:int,direct_empty:boolean,setext:boolean,path:array<string>>"
HEADINGS = f"array<{HEADING}>"
WIKILINK = "struct<pos:int,raw:string,target:string,display:string,anchor_kind:string,anchor:string,embed:boolean>"
WIKILINKS = f"array<{WIKILINK}>"
DIAGNOSTIC = "struct<code:string,severity:string,domain:string,constraint_id:string,location:string,message:string>"
DIAGNOSTICS = f"array<{DIAGNOSTIC}>"
RECORDS = "path string, content string"
