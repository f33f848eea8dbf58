"""The role views of FIXTURES.md as SQL common table expressions.

Names carry the prefix `x_` because the plain names are taken by the test tables.
"""

from __future__ import annotations

import re

ROLES: dict[str, str] = {
    "x_country": "select cast(r_regionkey as bigint) country_id, r_name country from region",
    "x_city": "select cast(n_nationkey as bigint) city_id, n_name city, cast(n_regionkey as bigint) country_id from nation",
    "x_address": """
        select c_custkey * 2 address_id, (c_custkey % 997)::varchar || ' Market Street' address, 'NA' district,
               cast(c_nationkey as bigint) city_id,
               case when c_custkey % 5 <> 0 then (c_custkey % 90000 + 10000)::varchar end postal_code,
               '555-' || (c_custkey % 10000)::varchar phone
        from customer
        union all
        select s_suppkey * 2 + 1, (s_suppkey % 997)::varchar || ' Harbour Road', 'NA', cast(s_nationkey as bigint),
               case when s_suppkey % 5 <> 0 then (s_suppkey % 90000 + 10000)::varchar end,
               '555-' || (s_suppkey % 10000)::varchar
        from supplier""",
    "x_store": "select s_suppkey store_id, s_suppkey manager_staff_id, s_suppkey * 2 + 1 address_id from supplier",
    "x_staff": """
        select s_suppkey staff_id, 'STAFF' first_name, s_name last_name, s_suppkey * 2 + 1 address_id,
               s_suppkey store_id, s_acctbal > 0 active, lower(s_name) username
        from supplier""",
    "x_actor": "select s_suppkey actor_id, 'SUPPLIER' first_name, s_name last_name from supplier",
    "x_customer": """
        select c_custkey customer_id, c_custkey % 10 store_id, c_mktsegment first_name, c_name last_name,
               case when c_custkey % 10 <> 0 then lower(c_name) || '@ex.com' end email,
               c_custkey * 2 address_id, c_acctbal > 0 active
        from customer""",
    "x_category": "select distinct cast(substring(p_brand, 7) as bigint) category_id, p_brand name from part",
    "x_film": """
        select p_partkey film_id, p_name title,
               case when p_partkey % 9 <> 2 then p_type || ' ' || p_brand || ' ' || p_name end description,
               cast(case when p_partkey % 50 = 49 then 1890 else 1990 + p_partkey % 30 end as integer) release_year, 1 + p_partkey % 4 language_id,
               cast(3 + p_partkey % 5 as integer) rental_duration,
               cast(p_retailprice as decimal(12,2)) rental_rate,
               case when p_size <> 50 then p_size end as length,
               cast(cast(p_retailprice as decimal(12,2)) * 2 as decimal(12,2)) replacement_cost,
               case p_partkey % 6 when 0 then 'G' when 1 then 'PG' when 2 then 'PG-13'
                    when 3 then 'R' when 4 then 'NC-17'
                    else case when p_partkey % 12 = 11 then 'NR' end end rating
        from part""",
    "x_film_category": """
        select p_partkey film_id, cast(substring(p_brand, 7) as bigint) category_id from part where p_partkey % 11 <> 5
        union all
        select p_partkey, (cast(substring(p_brand, 7) as bigint) + 6) % 25 + 1 from part where p_partkey % 7 = 3""",
    "x_film_actor": """
        select distinct l_suppkey actor_id, l_partkey film_id from lineitem
        where l_partkey % 13 <> 6 and l_suppkey % 17 <> 4""",
    "x_inventory": """
        select distinct l_partkey * 1000000000 + l_suppkey inventory_id, l_partkey film_id, l_suppkey % 10 store_id
        from lineitem""",
    "x_rental": """
        select l_orderkey * 10 + l_linenumber rental_id, any_value(o_orderdate) rental_date,
               min(l_partkey * 1000000000 + l_suppkey) inventory_id, any_value(o_custkey) customer_id,
               case when bool_or(l_returnflag = 'N') then null
                    when l_linenumber % 3 = 0 then any_value(o_orderdate) + interval 1 day
                    when l_linenumber % 3 = 1 then any_value(o_orderdate) + interval 5 day
                    else any_value(o_orderdate) + interval 9 day end return_date,
               min(l_partkey * 1000000000 + l_suppkey) % 1000000000 staff_id
        from lineitem join orders on l_orderkey = o_orderkey
        group by l_orderkey, l_linenumber""",
    "x_payment": """
        select ((row_number() over (partition by l_orderkey, l_linenumber, l_partkey % 1024
                   order by l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1)::hugeint * 1024
                + l_partkey % 1024) * 1000000000000000::hugeint + l_orderkey * 10 + l_linenumber payment_id,
               o_custkey customer_id, l_suppkey staff_id,
               case when l_partkey % 20 <> 0 then l_orderkey * 10 + l_linenumber end rental_id,
               cast(l_extendedprice as decimal(12,2)) amount, l_shipdate payment_date,
               cast(null as timestamp) last_update
        from lineitem join orders on l_orderkey = o_orderkey""",
    "x_film_text": "select doc_id film_id, source title, text description from documents",
    "x_language": """
        select distinct cast(ascii(lang) as bigint) * 256 + ascii(substring(lang, 2, 1)) language_id, lang name
        from documents""",
}


def with_roles(body: str, **extra: str) -> str:
    """`body` preceded by the common table expressions it uses, in definition order."""
    views = {**ROLES, **extra}
    used: set[str] = set()
    queue = [body]
    while queue:
        text = queue.pop()
        for name in views:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                queue.append(views[name])
    ctes = ",\n".join(f"{name} as materialized ({views[name].strip()})" for name in views if name in used)
    return f"with {ctes}\n{body.strip()}" if ctes else body.strip()
