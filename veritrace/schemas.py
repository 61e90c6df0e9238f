"""Schemas of the engine's tables, its enumerated values and fixed word lists."""

from __future__ import annotations

from pyspark.sql import types as T



BLOCKS = "block_ord BIGINT, id STRING, file STRING, start_line INT, end_line INT, heading ARRAY<STRING>, kind STRING, text STRING, images ARRAY<STRING>, likely_requirement BOOLEAN"
ITEMS = "item_ord BIGINT, id STRING, `group` STRING, kind STRING, assertion STRING, source STRUCT<file:STRING,line:INT>, text STRING, note STRING"
SYMBOLS = "family STRING, sym_ord BIGINT, name STRING, file STRING, line INT, end_line INT, owner STRING, kind STRING, doc STRING, handler STRING, http STRING, namespace STRING"
EVIDENCE = "ARRAY<STRUCT<file:STRING,line:STRING,quote:STRING>>"
VERDICTS = f"item_id STRING, verdict STRING, evidence {EVIDENCE}, reason STRING, missing ARRAY<STRING>"
RECHECKS = f"item_id STRING, second_verdict STRING, clauses ARRAY<STRUCT<text:STRING,evidence:{EVIDENCE}>>, evidence {EVIDENCE}, reason STRING"
WINDOWS = "item_id STRING, file STRING, start INT, end INT"
EXTRAS = "path STRING, http STRING, file STRING, line INT, handler STRING, owner STRING, `group` STRING"

# Enumerated values of our own; labels are put on when reports are rendered.
ROUTE_STATIC, ROUTE_AI = "static", "ai"
BY_SCRIPT, BY_PENDING, BY_AI, BY_BOUNCED, BY_RECHECK = "script", "pending", "ai_verified", "ai_bounced", "ai_recheck"
PLACE_OK, PLACE_FIX, PLACE_CONFIRM = "ok", "fix", "confirm"

# Words and limits that decide results.
NON_REQUIREMENT_HINTS = ("背景", "概述", "目标", "价值", "术语", "名词", "变更记录", "修订", "历史", "参考", "附录", "文档说明", "版本记录", "评审", "待办", "目录", "引言", "目的", "范围说明", "名词解释")
BASE_SECTION_HINTS = ("数据字段", "字段定义", "数据结构", "系统数据字典", "数据字典", "枚举定义", "核心业务逻辑规则", "业务逻辑规则", "业务规则", "核心业务流程", "业务流程", "状态定义", "状态机", "术语", "名词解释")
TOO_COMMON = ("api", "app", "admin", "inner", "internal", "open", "public", "v1", "v2", "list", "detail", "page", "info", "query", "get", "post", "update")
GENERIC_ACTIONS = ("get", "list", "detail", "query", "page", "search", "save", "add", "create", "update", "edit", "delete", "remove", "info", "view", "apply", "submit", "cancel", "close", "confirm", "status", "count")
CONTROL_WORDS = ("if", "for", "while", "switch", "catch", "return", "new", "super", "this", "assert", "do", "try", "synchronized", "else", "throw")
CAMEL_STOPWORDS = ("jsonObject", "getUserId", "setUserId", "toString", "equals", "hashCode", "rollbackFor", "required", "description", "summary", "timezone")
TYPE_SUFFIXES = ("Service", "ServiceImpl", "Controller", "API", "Mapper", "Repository", "Client", "DTO", "VO", "Entity", "Model", "Enum", "Config", "Util", "Utils", "Tools", "Handler", "Listener", "Job", "Task")
HTTP_WORDS = ("GET", "POST", "PUT", "DELETE", "PATCH")
MAPPINGS = {"RequestMapping": "ANY", "GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
SKIP_DIRS = ("target", "build", "out", "node_modules", ".git", "test")


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
