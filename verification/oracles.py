"""Expected results as SQL for the check engine, written over the role views.

The SQL states what a report means: a subquery for each indicator of each key where the Spark side
aggregates and joins, the full fan-out join where it multiplies group sizes, and plain joins where
the meaning is a join. Constraints are stated here once more, apart from the library's own lists.
"""

from __future__ import annotations

import re

from reelflow.sources.schemas import DDL
from verification.queries import AS_OF, FILM_SEARCH, FIRST_DAY, LAST_DAY, MATCH_TEXT, NEW_PAYMENT, NEW_RENTAL, PHRASE, SEARCH_TEXT
from verification.roles_sql import with_roles

_STOP = (
    "a about an are as at be by com de en for from how i in is it la of on or that the this to was what "
    "when where who will with und the www"
)
WORDS = r"regexp_extract_all(lower(concat_ws(' ', title, description)), '[\p{L}\p{N}_]{%d,}')"

PLACE = """
    select a.*, ci.city, co.country
    from x_address a join x_city ci on ci.city_id = a.city_id join x_country co on co.country_id = ci.country_id"""

SALES = """
    select p.amount, p.payment_date, r.rental_date, r.rental_id, r.customer_id, i.*
    from x_payment p join x_rental r on r.rental_id = p.rental_id join x_inventory i on i.inventory_id = r.inventory_id"""

# one list for each film, by a subquery; films without an actor are not shown
CAST = """
    select f.film_id "FID", f.title, f.description, c.name category, f.rental_rate::double price, f.length, f.rating,
           (select string_agg({name}, ', ' order by {name}) from x_film_actor b, x_actor a
            where b.film_id = f.film_id and a.actor_id = b.actor_id) actors
    from x_film f, x_film_category fc, x_category c
    where fc.film_id = f.film_id and c.category_id = fc.category_id
      and exists (select 1 from x_film_actor b, x_actor a where b.film_id = f.film_id and a.actor_id = b.actor_id)"""

# the meaning is this join: a payment counts once for each category of its film, or under category 0
ROLLUP = """
    select cast(p.payment_date as date) sales_date, i.store_id, coalesce(fc.category_id, 0) category_id,
           sum(p.amount) total_sales, count(*) tx_count
    from {payment} p
         join {rental} r on r.rental_id = p.rental_id
         join x_inventory i on i.inventory_id = r.inventory_id
         join x_store s on s.store_id = i.store_id
         left join x_film f on f.film_id = i.film_id
         left join x_film_category fc on fc.film_id = f.film_id
    where cast(p.payment_date as date) between date '{first}' and date '{last}'
    group by all"""

# brute force: every indicator of every customer is a subquery of its own
KPIS = """
    select c.customer_id,
           (select count(*) from {rental} r where r.customer_id = c.customer_id) rentals_count,
           (select count(*) from {rental} r where r.customer_id = c.customer_id and r.return_date is null) active_rentals,
           coalesce((select sum(p.amount) from {payment} p where p.customer_id = c.customer_id), 0)::decimal(18,2) total_spent,
           (select max(p.payment_date) from {payment} p where p.customer_id = c.customer_id) last_payment,
           (select max(r.rental_date) from {rental} r where r.customer_id = c.customer_id) last_rental
    from x_customer c"""

# brute force: every indicator of every copy is a subquery of its own
STATUS = """
    select i.inventory_id, i.film_id, i.store_id,
           not exists (select 1 from {rental} r where r.inventory_id = i.inventory_id and r.return_date is null) is_in_stock,
           (select count(*) from {rental} r where r.inventory_id = i.inventory_id) total_rentals,
           (select max(r.rental_date) from {rental} r where r.inventory_id = i.inventory_id) last_rental
    from x_inventory i"""

RAISED = f"""
    select p.payment_id, p.customer_id, p.payment_date,
           case when k.customer_id is null then p.amount else cast(p.amount * 1.05 as decimal(12,2)) end amount,
           case when k.customer_id is not null then '{AS_OF}' end last_update
    from x_payment p left join (
        select c.customer_id from x_customer c join x_address a on a.address_id = c.address_id
               join x_city ci on ci.city_id = a.city_id
        where c.active and ci.country_id between 1 and 100) k on k.customer_id = p.customer_id"""

OUT = "exists (select 1 from x_rental r where r.inventory_id = i.inventory_id and r.return_date is null)"


# the tables after many kinds of changes
CHANGED = {
    "new_rental": f"""
    select rental_id, rental_date, case when rental_id % 13 = 5 then (select max(inventory_id) from x_inventory) else inventory_id end inventory_id,
           case when rental_id % 13 = 2 then greatest(customer_id - 1, 1) else customer_id end customer_id,
           case when rental_id % 7 = 1 and return_date is null then rental_date + interval 3 day else return_date end return_date, staff_id
    from x_rental where rental_id % 11 <> 0
    union all
    select rental_id + {NEW_RENTAL}, rental_date + interval 10 day, inventory_id, customer_id, null, staff_id from x_rental where rental_id % 17 = 3""",
    "new_payment": f"""
    select payment_id, customer_id, staff_id, case when rental_id % 11 <> 0 then rental_id end rental_id,
           case when day(payment_date) = 5 then amount + 1 else amount end::decimal(12,2) amount, payment_date
    from x_payment where day(payment_date) <> 9
    union all
    select payment_id + {NEW_PAYMENT}::hugeint, customer_id, staff_id, rental_id + {NEW_RENTAL}, amount, payment_date + interval 10 day
    from x_payment where rental_id % 17 = 3""",
}

# what goes with some staff or stores: stores with their managers, staff with their stores, then all that refers to them
GONE = {
    "gone_store1": "select store_id from x_store where {store} or manager_staff_id in (select staff_id from x_staff where {staff})",
    "gone_staff": "select staff_id from x_staff where ({staff}) or store_id in (select store_id from gone_store1)",
    "gone_store": "select store_id from x_store where store_id in (select store_id from gone_store1) or manager_staff_id in (select staff_id from gone_staff)",
    "left_staff": "select * from x_staff where staff_id not in (from gone_staff) and store_id not in (from gone_store)",
    "left_store": "select * from x_store where store_id not in (from gone_store)",
    "left_customer": "select * from x_customer where store_id not in (from gone_store)",
    "left_inventory": "select * from x_inventory where store_id not in (from gone_store)",
    "left_rental": """select * from x_rental where staff_id not in (from gone_staff)
        and customer_id not in (select customer_id from x_customer where store_id in (from gone_store))
        and inventory_id not in (select inventory_id from x_inventory where store_id in (from gone_store))""",
    "left_payment": """select p.* exclude (rental_id), case when r.rental_id is null or l.rental_id is not null then p.rental_id end rental_id
        from x_payment p left join x_rental r on r.rental_id = p.rental_id left join left_rental l on l.rental_id = p.rental_id
        where p.staff_id not in (from gone_staff) and p.customer_id not in (select customer_id from x_customer where store_id in (from gone_store))""",
}


def _gone(staff: str = "false", store: str = "false") -> dict[str, str]:
    return {k: v.format(staff=staff, store=store) for k, v in GONE.items()}


def _kpi_columns(src: str) -> str:
    return f"""
    select customer_id, rentals_count, active_rentals, total_spent::double total_spent, last_payment::varchar last_payment,
           last_rental::varchar last_rental, total_spent::double balance_cached from {src}"""


def _search_terms(text: str) -> str:
    """Query words with their frequency, without short words and stopwords."""
    banned = ", ".join(f"'{w}'" for w in _STOP.split())
    return f"""
    select term, count(*) qf from (select unnest(string_split('{text}', ' ')) term)
    where length(term) >= 4 and term not in ({banned}) group by term"""


DOC_TERMS = f"""
    select film_id, term, count(*) dtf
    from (select film_id, unnest({WORDS % 4}) term from x_film_text)
    where term not in ({", ".join(f"'{w}'" for w in _STOP.split())}) group by film_id, term"""

SCORES = """
    with total as (select count(*) n from x_film_text),
    df as (select term, count(*) nf from doc_terms group by term),
    size as (select film_id, count(*) u, sum(ln(dtf) + 1) norm from doc_terms group by film_id)
    select d.film_id, sum(q.qf * (ln(d.dtf) + 1) / z.norm * z.u / (1 + 0.0115 * z.u)
                          * case when df.nf < 0.5 * t.n then ln((t.n - df.nf) / df.nf) else 0 end) score
    from doc_terms d join query_terms q on q.term = d.term join df on df.term = d.term
         join size z on z.film_id = d.film_id cross join total t
    group by d.film_id having score > 0"""


def _grown(table: str, key: str, columns: dict[str, str], rest: list[str]) -> str:
    """Five self-append steps, one after the other, each shifting dates by its number of years."""
    steps = []
    previous = f"select *, 0 mask, {key} source from {table}"
    for bit, years in enumerate((1, 2, 3, 4, 5)):
        shifted = ", ".join(
            [e.format(y=years) + f" {c}" for c, e in columns.items()] + [f"mask + {1 << bit} mask", "source"] + rest
        )
        kept = ", ".join([*columns, "mask", "source", *rest])
        steps.append(f"g{bit} as ({previous})")
        previous = f"select {kept} from g{bit} union all select {shifted} from g{bit}"
    return f"with {', '.join(steps)} {previous}"


def _uniform(what: str) -> str:
    return f"(cast('0x' || substring(md5('s1/{what}|' || id::varchar), 1, 13) as bigint) / 4503599627370496.0::double)"


def _uuid(seed: str, key: str) -> str:
    h = f"sha256('{seed}|' || {key}::varchar)"
    return " || '-' || ".join(f"substring({h}, {a}, {n})" for a, n in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)])


def _dense(table: str, key: str) -> str:
    return f"select {key}, row_number() over (order by {key} % 8191, {key}) - 1 idx from {table}"


PER_DAY = "(select count(*) // 30 + 1 from x_inventory)"
NEW_CUSTOMERS = f"""
    select n, (select max(customer_id) from x_customer) + 1 + n customer_id,
           (select max(address_id) from x_address) + 1 + n address_id
    from (select unnest(range({PER_DAY} // 10 + 1)) n)"""

FILM_CHANGES = """
    select film_id, title, description, rating,
           case when rating = 'PG' then 'NEW ' || title else title end new_title,
           case when rating = 'PG-13' then null when rating = 'R' then title || ' again' else description end new_description
    from x_film"""


SYNCED = """
    select case when rating = 'PG' then film_id + 1000000000 else film_id end film_id,
           case when {changed} then new_title else title end title,
           case when {changed} then new_description else description end description
    from film_changes where rating is distinct from 'G'
    union all
    select film_id + 1000000000, title, description from film_changes where rating is null"""


def _sync(changed: str) -> str:
    return with_roles(SYNCED.format(changed=changed), film_changes=FILM_CHANGES)


# Declared keys, once more: child.column > parent.key.
FOREIGN_KEYS = """
    address.city_id > city.city_id; city.country_id > country.country_id; customer.address_id > address.address_id;
    customer.store_id > store.store_id; film.language_id > language.language_id; film.original_language_id > language.language_id;
    film_actor.actor_id > actor.actor_id; film_actor.film_id > film.film_id; film_category.film_id > film.film_id;
    film_category.category_id > category.category_id; inventory.store_id > store.store_id; inventory.film_id > film.film_id;
    payment.rental_id > rental.rental_id; payment.customer_id > customer.customer_id; payment.staff_id > staff.staff_id;
    rental.staff_id > staff.staff_id; rental.inventory_id > inventory.inventory_id; rental.customer_id > customer.customer_id;
    staff.store_id > store.store_id; staff.address_id > address.address_id; store.manager_staff_id > staff.staff_id;
    store.address_id > address.address_id; sales_rollup_daily.store_id > store.store_id;
    sales_rollup_daily.category_id > category.category_id; customer_kpis.customer_id > customer.customer_id;
    inventory_status.inventory_id > inventory.inventory_id; inventory_status.film_id > film.film_id;
    inventory_status.store_id > store.store_id"""
UNIQUE_KEYS = """
    actor actor_id; address address_id; category category_id; city city_id; country country_id; customer customer_id; film film_id;
    film_actor actor_id,film_id; film_category film_id,category_id; film_text film_id; inventory inventory_id; language language_id;
    payment payment_id; rental rental_id; rental rental_date,inventory_id,customer_id; staff staff_id; store store_id;
    store manager_staff_id; sales_rollup_daily sales_date,store_id,category_id; customer_kpis customer_id;
    inventory_status inventory_id; audit_rental audit_id; audit_payment audit_id"""
# Required columns, once more.
REQUIRED = """
    actor: actor_id first_name last_name last_update; address: address_id address district city_id phone last_update;
    category: category_id name last_update; city: city_id city country_id last_update; country: country_id country last_update;
    customer: customer_id store_id first_name last_name address_id active create_date;
    film: film_id title language_id rental_duration rental_rate replacement_cost last_update;
    film_actor: actor_id film_id last_update; film_category: film_id category_id last_update; film_text: film_id title;
    inventory: inventory_id film_id store_id last_update; language: language_id name last_update;
    payment: payment_id customer_id staff_id amount payment_date;
    rental: rental_id rental_date inventory_id customer_id staff_id last_update;
    staff: staff_id first_name last_name address_id store_id active username last_update;
    store: store_id manager_staff_id address_id last_update; audit_rental: audit_id action changed_at; audit_payment: audit_id action changed_at;
    sales_rollup_daily: sales_date store_id category_id total_sales tx_count;
    customer_kpis: customer_id rentals_count active_rentals total_spent balance_cached;
    inventory_status: inventory_id film_id store_id is_in_stock total_rentals"""
#: What the role views leave out.
NO_TABLES = ("audit_rental", "audit_payment")
ABSENT = {(t, "last_update") for t in ("actor address category city country film film_actor film_category inventory language "
                                       "rental staff store").split()} | {("customer", "create_date")}  # fmt: skip


def _foreign_keys() -> str:
    parts = []
    for pair in FOREIGN_KEYS.split(";"):
        (child, column), (parent, key) = (x.strip().split(".") for x in pair.split(">"))
        if (child, column) == ("film", "original_language_id"):
            parts.append(f"select '{child}' table_name, '{column}' constraint_columns, '{parent}' parent_table, false checked, null::bigint bad_keys, null::bigint bad_rows")
            continue
        parts.append(f"""
            select '{child}' table_name, '{column}' constraint_columns, '{parent}' parent_table, true checked,
                   count(distinct x.{column}) bad_keys, count(x.{column}) bad_rows
            from x_{child} x where x.{column} is not null
              and not exists (select 1 from x_{parent} y where y.{key} = x.{column})""")
    return " union all ".join(parts)


def _orphans_after_delete() -> str:
    """The report over what is left; there are no derived tables in it."""
    parts = []
    for row in _foreign_keys().split(" union all "):
        child = row.split("'")[1]
        if child in ("sales_rollup_daily", "customer_kpis", "inventory_status"):
            names = row.split("'")
            row = f"select '{child}' table_name, '{names[3]}' constraint_columns, '{names[5]}' parent_table, false checked, null::bigint bad_keys, null::bigint bad_rows"
        for name in ("staff", "store", "customer", "inventory", "rental", "payment"):
            row = row.replace(f"x_{name} ", f"left_{name} ")
        parts.append(row)
    return with_roles(" union all ".join(parts), **_gone(store="store_id % 3 = 1"))


def _unique_keys() -> str:
    parts = []
    for pair in UNIQUE_KEYS.split(";"):
        table, columns = pair.split()
        if table in NO_TABLES:
            parts.append(f"select '{table}' table_name, '{columns}' constraint_columns, false checked, null::bigint bad_keys, null::bigint bad_rows")
            continue
        parts.append(f"""
            select '{table}' table_name, '{columns}' constraint_columns, true checked, count(*) bad_keys, coalesce(sum(n), 0)::bigint bad_rows
            from (select count(*) n from x_{table} group by {columns} having count(*) > 1)""")
    return " union all ".join(parts)


def _required(absent: set[tuple[str, str]]) -> str:
    parts = []
    for group in REQUIRED.split(";"):
        table, columns = group.strip().split(": ")
        for c in columns.split():
            count, source = ("null::bigint", "") if (table, c) in absent or table in NO_TABLES else (f"count(*) - count({c})", f"from x_{table}")
            parts.append(f"select '{table}' table_name, '{c}' column_name, {count} n_null {source}")
    return " union all ".join(parts)


DERIVED = {
    "x_sales_rollup_daily": ROLLUP.format(payment="x_payment", rental="x_rental", first=FIRST_DAY, last=LAST_DAY),
    "x_customer_kpis": f"select *, total_spent balance_cached from ({KPIS.format(payment='x_payment', rental='x_rental')})",
    "x_inventory_status": STATUS.format(rental="x_rental"),
}


# the columns of the role views
ROLE_COLUMNS = {
    "country": "country_id country", "city": "city_id city country_id", "address": "address_id address district city_id postal_code phone",
    "store": "store_id manager_staff_id address_id", "staff": "staff_id first_name last_name address_id store_id active username",
    "actor": "actor_id first_name last_name", "customer": "customer_id store_id first_name last_name email address_id active",
    "category": "category_id name",
    "film": "film_id title description release_year language_id rental_duration rental_rate length replacement_cost rating",
    "film_category": "film_id category_id", "film_actor": "actor_id film_id", "inventory": "inventory_id film_id store_id",
    "rental": "rental_id rental_date inventory_id customer_id return_date staff_id",
    "payment": "payment_id customer_id staff_id rental_id amount payment_date last_update",
    "film_text": "film_id title description", "language": "language_id name",
}
DERIVED_COLUMNS = {
    "sales_rollup_daily": "sales_date store_id category_id total_sales tx_count",
    "customer_kpis": "customer_id rentals_count active_rentals total_spent last_payment last_rental balance_cached",
    "inventory_status": "inventory_id film_id store_id is_in_stock total_rentals last_rental",
}


def _nulls(table: str, columns: str) -> str:
    return " union all ".join(
        f"select '{table}' table_name, '{c}' column_name, count(*) - count({c}) n_null from x_{table}"
        for c in columns.split()
    )


# What a clean-up of the last 365 days leaves behind.
LEFT_RENTAL = f"select * from x_rental where rental_date < timestamp '{AS_OF}' - interval 365 day"
LEFT_PAYMENT = f"""
    select p.payment_id, p.customer_id, p.amount, p.payment_date,
           case when exists (select 1 from x_rental r where r.rental_id = p.rental_id
                             and r.rental_date >= timestamp '{AS_OF}' - interval 365 day)
                then null else p.rental_id end rental_id
    from x_payment p where p.payment_date < timestamp '{AS_OF}' - interval 365 day"""

FOLDED = f"""
    select k.*,
       (select count(*) from x_rental r where r.customer_id = k.customer_id
           and r.rental_date >= timestamp '{AS_OF}' - interval 365 day) rentals_w,
       coalesce((select sum(p.amount) from x_payment p where p.customer_id = k.customer_id
           and p.payment_date >= timestamp '{AS_OF}' - interval 365 day), 0)::decimal(18,2) amount_w,
       k.customer_id in (select customer_id from x_customer order by customer_id limit 500) chosen
    from x_customer_kpis k"""

REWARDED = """
    select customer_id from x_payment where cast(payment_date as date) between date '{first}' and date '{last}'
    group by customer_id having sum(amount) > 50000.00 and count(customer_id) > 1"""


def oracle_sql() -> dict[str, str]:
    name = "a.first_name || ' ' || a.last_name"
    nicer = (
        "upper(a.first_name[1]) || lower(a.first_name[2:]) || ' ' || upper(a.last_name[1]) || lower(a.last_name[2:])"
    )
    sql: dict[str, str] = {}
    add = sql.__setitem__

    # --- scans, sources, sinks
    add("load_table", with_roles("""
        select rental_id, rental_date::varchar rental_date, inventory_id, customer_id, return_date::varchar return_date,
               staff_id from x_rental"""))
    add("write_payments_by_month", with_roles("""
        select case when payment_date >= timestamp '1996-01-01' and payment_date < timestamp '2001-01-01'
                    then strftime(payment_date, '%Y-%m-01') else 'default' end payment_month,
               count(*) n, sum(amount)::double amount
        from x_payment group by 1"""))
    add("overwrite_full", with_roles("""
        select customer_id, rentals_count, active_rentals, (total_spent * 2)::double total_spent,
               last_payment::varchar last_payment, last_rental::varchar last_rental, (total_spent * 2)::double balance_cached
        from x_customer_kpis""", **DERIVED))
    add("overwrite_range", with_roles("""
        select cast(payment_date as date)::varchar sales_date, count(*) tx_count, sum(amount)::double total_sales
        from x_payment where year(payment_date) <> 1998 or amount > 100000 group by 1"""))
    add("append_with_keys", with_roles("""
        select customer_id, last_name, email from x_customer
        union all select customer_id + (select max(customer_id) - min(customer_id) + 1 from x_customer), last_name, null from x_customer"""))
    add("update_join", with_roles(f"""
        select c.customer_id, case when s.store_id is null then c.active else false end active,
               case when s.store_id is null then c.email else s.username end email,
               case when s.store_id is not null then '{AS_OF}' end last_update
        from x_customer c left join (select * from x_staff where not active) s on s.store_id = c.store_id"""))
    add("update_join_repeated", with_roles("""
        select customer_id, active, coalesce((select min(inventory_id)::varchar from x_rental r where r.customer_id = c.customer_id), email) email
        from x_customer c"""))
    add("delete_where", with_roles("""
        select f.film_id, f.length, nullif((select count(*) from x_film_actor a where a.film_id = f.film_id), 0) n_actors
        from x_film f where f.length <= 40 or f.length is null"""))

    # --- functions
    add("text_functions", with_roles(f"""
        select film_id, upper(title) || ':' || lower(title) cased, upper(title[1]) || lower(title[2:]) capital,
               substring(description, 5, 20) excerpt, reverse(substring(description, 5, 20)) backwards,
               strlen(description) n_bytes, length(description) n_chars, sha1(description) signature,
               {_uuid('film', 'film_id')} uuid
        from x_film_text"""))
    add("date_functions", with_roles("""
        select rental_id, year(rental_date)::integer y, month(rental_date)::integer m, cast(rental_date as date)::varchar as day,
               datediff('day', rental_date, return_date)::integer days_out,
               cast(date_trunc('month', rental_date) as date)::varchar month_start,
               cast(last_day(rental_date) as date)::varchar month_end, (rental_date + interval 1 year)::varchar next_year,
               (rental_date - interval 30 day)::varchar month_ago,
               case when return_date is not null then greatest(rental_date, return_date) end::varchar latest,
               coalesce(return_date, rental_date)::varchar known
        from x_rental"""))
    add("group_concat", with_roles("""
        select film_id, list_aggregate(list_sort(list_distinct(list(store_id::varchar))), 'string_agg', '|') stores,
               any_value(categories) categories
        from x_inventory left join (select film_id, string_agg(name, ', ' order by name) categories
                                    from x_film_category join x_category using (category_id) group by film_id) using (film_id)
        group by film_id"""))

    # --- views
    person = "first_name || ' ' || last_name"
    add("customer_list", with_roles(f"""
        select c.customer_id "ID", {person} name, l.address, l.postal_code "zip code", l.phone, l.city, l.country,
               case when c.active then 'active' else '' end notes, c.store_id "SID"
        from x_customer c join place l on l.address_id = c.address_id""", place=PLACE))
    add("staff_list", with_roles(f"""
        select s.staff_id "ID", {person} name, l.address, l.postal_code "zip code", l.phone, l.city, l.country, s.store_id "SID"
        from x_staff s join place l on l.address_id = s.address_id""", place=PLACE))
    add("film_list", with_roles(CAST.format(name=name)))
    add("nicer_but_slower_film_list", with_roles(CAST.format(name=nicer)))
    add("sales_by_store", with_roles("""
        select l.city || ',' || l.country store, m.first_name || ' ' || m.last_name manager, sum(x.amount)::double total_sales
        from sales x join x_store s on s.store_id = x.store_id join place l on l.address_id = s.address_id
             join x_staff m on m.staff_id = s.manager_staff_id
        group by s.store_id, l.city, l.country, m.first_name, m.last_name""", place=PLACE, sales=SALES))
    add("sales_by_film_category", with_roles("""
        select c.name category, sum(x.amount)::double total_sales
        from sales x join x_film f on f.film_id = x.film_id join x_film_category fc on fc.film_id = f.film_id
             join x_category c on c.category_id = fc.category_id
        group by c.name""", sales=SALES))
    add("actor_info", with_roles("""
        select a.actor_id, a.first_name, a.last_name, string_agg(e.entry, '; ' order by e.name) film_info
        from x_actor a left join (
            select fa.actor_id, c.name, c.name || ': ' || string_agg(f.title, ', ' order by f.title) entry
            from x_film_actor fa join x_film f on f.film_id = fa.film_id
                 join x_film_category fc on fc.film_id = f.film_id join x_category c on c.category_id = fc.category_id
            group by fa.actor_id, c.category_id, c.name) e on e.actor_id = a.actor_id
        group by a.actor_id, a.first_name, a.last_name"""))

    # --- analytics
    add("financial_performance", with_roles("""
        select l.country, l.city, s.store_id, c.name category, year(x.rental_date)::integer as year,
               month(x.rental_date)::integer as month, count(distinct x.rental_id) rental_count,
               count(distinct x.customer_id) unique_customers, sum(x.amount)::double total_revenue,
               sum(x.amount)::double / count(*) avg_payment,
               round(sqrt(greatest(count(*)::hugeint * sum((x.amount * 100)::hugeint * (x.amount * 100)::hugeint)
                     - sum((x.amount * 100)::hugeint) * sum((x.amount * 100)::hugeint), 0)::double) / count(*) / 100, 4)
                   payment_volatility,
               l.country || ' - ' || l.city || ' (' || c.name || ')' location_tag
        from sales x join x_customer cu on cu.customer_id = x.customer_id join x_film f on f.film_id = x.film_id
             join x_film_category fc on fc.film_id = f.film_id join x_category c on c.category_id = fc.category_id
             join x_film_actor fa on fa.film_id = f.film_id join x_actor a on a.actor_id = fa.actor_id
             join x_store s on s.store_id = x.store_id join place l on l.address_id = s.address_id
        group by l.country, l.city, s.store_id, c.name, year(x.rental_date), month(x.rental_date)
        having count(distinct x.rental_id) > 5""", place=PLACE, sales=SALES))
    sql["performance_of_stored_facts"] = sql["financial_performance"]
    # brute force: every question about every customer is a subquery of its own
    add("customer_profile", with_roles("""
        select c.customer_id, upper(c.last_name) || ', ' || c.first_name || ' [' || strlen(c.email)::varchar || ']' client_profile,
               (select sum(p.amount) from x_payment p where p.customer_id = c.customer_id)::double total_lifetime_value,
               (select w.title from watched w where w.customer_id = c.customer_id
                order by w.length desc nulls last, w.title limit 1) longest_rental_choice,
               (select count(distinct fc.category_id) from taste fc where fc.customer_id = c.customer_id) category_diversity_index,
               (select sum(datediff('day', r.rental_date, r.return_date))::double / count(*) from x_rental r
                where r.customer_id = c.customer_id and r.return_date is not null) avg_return_delay_days
        from x_customer c where c.active""",
        watched="""select r.customer_id, f.title, f.length from x_rental r join x_inventory i on i.inventory_id = r.inventory_id
                   join x_film f on f.film_id = i.film_id""",
        taste="""select r.customer_id, fc.category_id from x_rental r join x_inventory i on i.inventory_id = r.inventory_id
                 join x_film_category fc on fc.film_id = i.film_id"""))
    # the fan-out itself: each rental of a customer meets each payment
    add("customer_activity_top", with_roles("""
        select c.customer_id, count(r.rental_id) cnt, coalesce(sum(p.amount), 0)::double amt
        from x_customer c
             left join x_rental r on r.customer_id = c.customer_id
             left join x_payment p on p.customer_id = c.customer_id
        group by c.customer_id order by coalesce(sum(p.amount), 0) desc, c.customer_id limit 200"""))

    # --- search
    add("fulltext_search", with_roles("""
        select f.film_id, f.title, round(s.score, 6) relevance_score, sha1(f.title || t.description) content_signature,
               reverse(substring(t.description, 5, 20)) nonsense_processing,
               (select count(*) from x_inventory i where i.film_id = f.film_id) physical_copies_count
        from scores s join x_film_text t on t.film_id = s.film_id join x_film f on f.film_id = s.film_id""",
        doc_terms=DOC_TERMS, query_terms=_search_terms(SEARCH_TEXT), scores=SCORES))
    add("search_top_by_rate", with_roles("""
        select f.film_id, f.title, f.rental_rate::double rental_rate
        from scores s join x_film f on f.film_id = s.film_id order by f.rental_rate desc, f.film_id limit 100""",
        doc_terms=DOC_TERMS, query_terms=_search_terms(MATCH_TEXT), scores=SCORES))
    positions = f"""
        select film_id, unnest(w) term, generate_subscripts(w, 1) pos
        from (select film_id, {WORDS % 1} w from x_film_text)"""
    add("build_term_vectors", with_roles("""
        select t.film_id, count(distinct p.term) n_terms, count(p.term) n_positions, min(p.term) first_term,
               (select string_agg(q.pos::varchar, ',' order by q.pos) from positions q
                where q.film_id = t.film_id and q.term = min(p.term)) first_positions
        from x_film_text t left join positions p on p.film_id = t.film_id group by t.film_id""", positions=positions))
    add("build_term_index", with_roles("""
        select film_id, term, dtf, count(*) over (partition by film_id) u,
               round(sum(ln(dtf) + 1) over (partition by film_id), 6) norm
        from doc_terms""", doc_terms=DOC_TERMS))
    add("indexed_search", with_roles("select film_id, round(score, 6) score from scores",
                                     doc_terms=DOC_TERMS, query_terms=_search_terms(SEARCH_TEXT), scores=SCORES))

    # --- workload
    add("bulk_price_update", with_roles(
        "select payment_id::varchar payment_id, customer_id, amount::double amount, last_update from raised", raised=RAISED))
    add("bump_latest_payments", with_roles("""
        select payment_id::varchar payment_id, (case when payment_id in (select payment_id from x_payment order by payment_id desc limit 10)
                            then amount + 0.05 else amount end)::double amount from x_payment"""))
    add("table_counts", with_roles("""
        select (select count(*) from x_rental) total_rentals, (select count(*) from x_payment) total_payments"""))

    # --- stock
    add("inventory_held_by_customer", with_roles("""
        select inventory_id, customer_id, n_open from (
            select inventory_id, customer_id, row_number() over (partition by inventory_id order by rental_id) k,
                   count(*) over (partition by inventory_id) n_open
            from x_rental where return_date is null) where k = 1"""))
    add("inventory_in_stock", with_roles(f"select inventory_id, film_id, store_id, not {OUT} in_stock from x_inventory i"))
    add("film_in_stock", with_roles(f"select film_id, store_id, inventory_id from x_inventory i where not {OUT}"))
    add("film_not_in_stock", with_roles(f"select film_id, store_id, inventory_id from x_inventory i where {OUT}"))
    add("film_stock_counts", with_roles(f"""
        select film_id, store_id, count(*) filter (where not is_out) n_in, count(*) filter (where is_out) n_out
        from (select film_id, store_id, {OUT} is_out from x_inventory i) group by film_id, store_id"""))

    # --- finance
    for key, lost in [
        ("customer_balance", "0"),
        ("customer_balance_with_replacement",
         "sum(case when late > 2 * rental_duration then replacement_cost else 0 end)"),
    ]:
        add(key, with_roles(f"""
            select c.customer_id, coalesce(f.rent, 0)::double rent_fees, coalesce(f.late_fee + f.lost_fee, 0)::double late_fees,
                   coalesce(p.paid, 0)::double payments,
                   (coalesce(f.rent, 0) + coalesce(f.late_fee + f.lost_fee, 0) - coalesce(p.paid, 0))::double balance
            from x_customer c
            left join (select customer_id, sum(rental_rate) rent, sum(case when late > 0 then late else 0 end) late_fee, {lost} lost_fee
                       from (select r.customer_id, f.*, datediff('day', r.rental_date, r.return_date) - f.rental_duration late
                             from x_rental r join x_inventory i on i.inventory_id = r.inventory_id
                                  join x_film f on f.film_id = i.film_id
                             where r.rental_date <= timestamp '2000-06-30') group by customer_id) f on f.customer_id = c.customer_id
            left join (select customer_id, sum(amount) paid from x_payment where payment_date <= timestamp '2000-06-30'
                       group by customer_id) p on p.customer_id = c.customer_id"""))
    add("rewards_report", with_roles("select c.* from x_customer c where c.customer_id in (select * from best)",
                                     best=REWARDED.format(first="2000-02-01", last="2000-02-29")))
    add("count_rewardees", with_roles("select count(*) count_rewardees from x_customer where customer_id in (select * from best)",
                                      best=REWARDED.format(first="1999-12-01", last="1999-12-31")))

    # --- the SQL surface
    add("sql_stock", with_roles(f"""
        select inventory_id, not {OUT} in_stock,
               (select r.customer_id from x_rental r where r.inventory_id = i.inventory_id and r.return_date is null
                order by r.rental_id limit 1) customer_id
        from x_inventory i"""))
    sql["sql_balance"] = f"select customer_id, balance from ({sql['customer_balance']})"
    sql["sql_film_in_stock"], sql["sql_film_not_in_stock"] = sql["film_in_stock"], sql["film_not_in_stock"]
    sql["sql_rewards"] = sql["rewards_report"]
    add("sql_rewards_months", with_roles("select c.* from x_customer c where c.customer_id in (select * from best)",
                                         best=REWARDED.format(first="1999-12-01", last="1999-12-31")))

    # --- derived tables
    add("refresh_sales_rollup", with_roles(f"""
        select sales_date::varchar sales_date, store_id, category_id, total_sales::double total_sales, tx_count,
               '{AS_OF}' last_update from x_sales_rollup_daily""", **DERIVED))
    add("refresh_customer_kpis", with_roles(
        _kpi_columns("x_customer_kpis").replace("balance_cached from", f"balance_cached, '{AS_OF}' last_update from"), **DERIVED))
    add("recompute_balances", sql["refresh_customer_kpis"])
    add("refresh_inventory_status", with_roles(f"""
        select inventory_id, film_id, store_id, is_in_stock, total_rentals, last_rental::varchar last_rental,
               '{AS_OF}' last_update from x_inventory_status""", **DERIVED))
    add("populate_extended_tables", with_roles("""
        select 'customer_kpis' table_name, count(*) n, sum(total_spent)::double total from x_customer_kpis
        union all select 'inventory_status', count(*), sum(total_rentals)::double from x_inventory_status
        union all select 'sales_rollup_daily', count(*), sum(total_sales)::double from x_sales_rollup_daily""", **DERIVED))
    left = {"left_rental": LEFT_RENTAL, "left_payment": LEFT_PAYMENT}
    add("cleanup_recent", with_roles("select payment_id::varchar payment_id, rental_id, amount::double amount from left_payment", **left))
    add("cleanup_recent_rentals", with_roles("select rental_id, inventory_id, customer_id, rental_date::varchar rental_date from left_rental", **left))
    add("cleanup_recent_status", with_roles("""
        select inventory_id, film_id, store_id, is_in_stock, total_rentals, last_rental::varchar last_rental from left_status""",
        **left, left_status=STATUS.format(rental="left_rental")))
    add("cleanup_recent_rollup", with_roles(f"""
        select sales_date::varchar sales_date, store_id, category_id, total_sales::double total_sales, tx_count
        from (select * from x_sales_rollup_daily where sales_date not between date '2000-06-15' and date '2001-06-15'
              union all select * from fresh)""",
        **left, **DERIVED, fresh=ROLLUP.format(payment="left_payment", rental="left_rental", first="2000-06-15", last="2001-06-15")))
    add("cleanup_recent_kpis", with_roles(
        _kpi_columns("fresh_kpis"), **left, fresh_kpis=KPIS.format(payment="left_payment", rental="left_rental")))
    add("fold_kpi_window", with_roles(f"""
        select customer_id, rentals_count + case when chosen then rentals_w else 0 end rentals_count, active_rentals,
               (total_spent + case when chosen then amount_w else 0 end)::double total_spent,
               last_payment::varchar last_payment, last_rental::varchar last_rental,
               (total_spent + case when chosen then 2 * amount_w else 0 end)::double balance_cached,
               case when chosen then '{AS_OF}' else '1995-01-01 00:00:00' end last_update
        from folded""", **DERIVED, folded=FOLDED))

    # --- inflation and seeding
    add("inflate_rental", with_roles("""
        select customer_id, year(rental_date)::integer y, count(*) n, count(return_date) n_returned
        from (select *, row_number() over (partition by rental_date, inventory_id, customer_id order by mask, source) k from grown)
        where k = 1 or mask = 0 group by customer_id, year(rental_date)""",
        grown=_grown("x_rental", "rental_id", {"rental_date": "rental_date + interval {y} year",
                     "return_date": "return_date + interval {y} year"}, ["inventory_id", "customer_id"])))
    add("inflate_payment", with_roles("""
        select customer_id, strftime(payment_date, '%Y-%m') payment_month, count(*) n, count(rental_id) n_with_rental,
               sum(amount)::double amount
        from grown group by 1, 2""",
        grown=_grown("x_payment", "payment_id", {"payment_date": "payment_date + interval {y} year", "rental_id": "null"},
                     ["customer_id", "amount"])))
    # whatever the new keys are: every row has its own, source rows keep theirs, and no payment loses its rental
    add("inflated_keys", with_roles("""
        select 'payment_id' key_name, count(*) * 32 n_rows, count(*) * 32 n_keys, count(*) n_source_keys from x_payment
        union all
        select 'rental_id', count(*), count(*), (select count(*) from x_rental)
        from (select *, row_number() over (partition by rental_date, inventory_id, customer_id order by mask, source) k from grown)
        where k = 1 or mask = 0
        union all
        select 'payment meets rental', count(*), count(distinct payment_id), null
        from x_payment p join x_rental r on r.rental_id = p.rental_id and r.customer_id = p.customer_id""",
        grown=_grown("x_rental", "rental_id", {"rental_date": "rental_date + interval {y} year",
                     "return_date": "return_date + interval {y} year"}, ["inventory_id", "customer_id"])))
    add("seed_customers", with_roles(f"""
        select customer_id, 1::bigint store_id, 'C' || {_uuid('s1/name', 'n')} first_name, 'X' last_name,
               {_uuid('s1/email', 'n')} || '@ex.com' email, address_id, true active, '{AS_OF}' create_date,
               'Addr ' || {_uuid('s1/address', 'n')} address, '000' phone
        from new_customers""", new_customers=NEW_CUSTOMERS))
    add("seed_synthetic_data", with_roles(f"""
        select (select max(rental_id) from x_rental) + 1 + s.id rental_id,
               (timestamp '{AS_OF}' - to_days(s.day))::varchar rental_date, i.inventory_id, c.customer_id,
               case when s.returned > 0.5 then (timestamp '{AS_OF}' - to_days(s.day) + to_days(s.kept))::varchar end return_date,
               f.staff_id, ((select max(payment_id) from x_payment) + 1 + s.id)::varchar payment_id, s.amount,
               (timestamp '{AS_OF}' - to_days(s.day))::varchar payment_date
        from slots s join copies i on i.idx = s.copy join people c on c.idx = s.customer join workers f on f.idx = s.staff""",
        new_customers=NEW_CUSTOMERS,
        everyone="select customer_id from x_customer union all select customer_id from new_customers",
        copies=_dense("x_inventory", "inventory_id"),
        people=_dense("everyone", "customer_id"),
        workers=_dense("x_staff", "staff_id"),
        slots=f"""
        select id, (id // per_day)::integer as day, floor({_uniform('copy')} * (select count(*) from copies))::bigint as copy,
               floor({_uniform('customer')} * (select count(*) from people))::bigint customer,
               floor({_uniform('staff')} * (select count(*) from workers))::bigint staff, {_uniform('returned')} returned,
               floor({_uniform('days')} * 3)::integer kept,
               (2.99::double + {_uniform('amount')} * 7)::decimal(5,2)::double amount
        from (select unnest(range(30 * {PER_DAY})) id, {PER_DAY} per_day)"""))

    # --- sync, audit, checks
    same = "(title <> new_title or description <> new_description)"
    add("sync_film_text", _sync(f"coalesce({same}, false)"))
    add("sync_film_text_null_safe", _sync("(title is distinct from new_title or description is distinct from new_description)"))
    add("stamp_last_update", with_roles(f"""
        select customer_id, case when active then lower(last_name) else email end email,
               case when active and lower(last_name) is distinct from email then '{AS_OF}' else '1995-01-01 00:00:00' end last_update
        from x_customer"""))
    image = lambda row, when: f"""{row}.payment_id::varchar {when}_payment_id, {row}.customer_id::varchar {when}_customer_id,
               strftime({row}.payment_date, '%Y-%m-%d %H:%M:%S') || ' ' {when}_payment_date"""  # noqa: E731
    text = {"country": "country", "city": "city", "address": "address", "staff": "first_name", "actor": "first_name",
            "customer": "first_name", "category": "name", "film": "title", "language": "name"}
    add("stamp_tables", with_roles(" union all ".join(
        [f"select '{n}' table_name, count(*) n, count(*) filter ({n}_id % 10 = 0 and {c} is distinct from 'changed') n_stamped from x_{n}" for n, c in text.items()]
        + [f"select '{n}' table_name, count(*) n, 0 n_stamped from x_{n}" for n in ("store", "film_category", "film_actor", "inventory", "rental")])))
    add("audit_changes", with_roles(f"""
        select payment_id::varchar audit_id, payment_id::varchar payment_id,
               case when b.payment_id is null then 'INSERT' when a.payment_id is null then 'DELETE' else 'UPDATE' end as action,
               '{AS_OF}' changed_at, 'batch' actor_user, {image("b", "before")}, null before_last_update, {image("a", "after")},
               a.last_update || ' ' after_last_update, b.amount::double old_amount, a.amount::double new_amount
        from (select * from x_payment where payment_date < timestamp '2001-06-01') b
             full join (select * from raised where payment_date >= timestamp '1995-06-01') a using (payment_id)
        where b.payment_id is null or a.payment_id is null or a.last_update is not null""", raised=RAISED))
    add("audit_bridge", with_roles("""
        select film_id, count(*) n, count(*) n_ids, 'DELETE' as action from x_film_actor where film_id % 2 = 0 group by film_id"""))
    # --- upkeep by changes: always the full answer over the changed tables
    add("balances_at", with_roles("""
        select p.customer_id, p.as_of::varchar as as_of, coalesce(sum(c.rent), 0)::double rent_fees, coalesce(sum(c.late), 0)::double late_fees,
               coalesce(sum(c.paid), 0)::double payments, coalesce(sum(c.rent + c.late - c.paid), 0)::double balance
        from (select distinct customer_id, rental_date as_of from x_rental) p
             left join charges c on c.customer_id = p.customer_id and c.due <= p.as_of
        group by p.customer_id, p.as_of""", charges="""
        select r.customer_id, r.rental_date due, f.rental_rate rent,
               greatest(coalesce(datediff('day', r.rental_date, r.return_date) - f.rental_duration, 0), 0)::decimal(12,2) late, 0::decimal(12,2) paid
        from x_rental r join x_inventory i on i.inventory_id = r.inventory_id join x_film f on f.film_id = i.film_id
        union all select customer_id, payment_date, 0, 0, amount from x_payment"""))
    add("upkeep_kpis", with_roles(_kpi_columns("fresh_kpis"), **CHANGED, fresh_kpis=KPIS.format(rental="new_rental", payment="new_payment")))
    add("upkeep_status", with_roles("""
        select inventory_id, film_id, store_id, is_in_stock, total_rentals, last_rental::varchar last_rental from fresh_status""",
        **CHANGED, fresh_status=STATUS.format(rental="new_rental")))
    add("upkeep_rollup", with_roles("""
        select sales_date::varchar sales_date, store_id, category_id, total_sales::double total_sales, tx_count from fresh""",
        **CHANGED, fresh=ROLLUP.format(payment="new_payment", rental="new_rental", first=FIRST_DAY, last=LAST_DAY)))
    add("log_read_back", with_roles("""
        select version, payment_id::varchar payment_id, customer_id, staff_id, rental_id, amount::double amount, payment_date::varchar payment_date
        from (select 'after' as version, payment_id, customer_id, staff_id, rental_id, amount, payment_date from new_payment
              union all select 'before', payment_id, customer_id, staff_id, rental_id, amount, payment_date from x_payment)""", **CHANGED))
    add("delete_cascading", with_roles(" union all ".join(
        [f"select '{n}' table_name, count(*) n from left_{n}" for n in ("staff", "store", "customer", "inventory", "rental", "payment")]
        + [f"select '{n}', count(*) from x_{n}" for n in ("address", "film", "film_actor")]
        + ["select 'payment without rental', count(*) from left_payment where rental_id is null"]), **_gone(staff="staff_id % 4 = 3")))
    add("orphans_after_delete", _orphans_after_delete())
    add("phrase_search", with_roles(f"""
        select film_id, len(hits)::bigint n_hits, hits[1]::integer first_position
        from (select film_id, list_filter(range(1, len(w) + 1), lambda k: w[k] = '{PHRASE.split()[0]}' and w[k + 1] = '{PHRASE.split()[1]}') hits
              from (select film_id, {WORDS % 1} w from x_film_text))
        where len(hits) > 0"""))
    renamed = "select * from synced where title not like 'NEW %'"
    for key, table in (("segmented_search", "select * from synced"), ("merged_search", renamed)):
        add(key, with_roles("select film_id, round(score, 6) score from scores", film_changes=FILM_CHANGES,
            synced=SYNCED.format(changed=f"coalesce({same}, false)"),
            kept_films=table, doc_terms=DOC_TERMS.replace("x_film_text", "kept_films"), query_terms=_search_terms(FILM_SEARCH),
            scores=SCORES.replace("x_film_text", "kept_films")))
    paid = """
        select {by}, count(distinct r.rental_id) rentals, count(distinct r.customer_id) customers
        from x_payment p join x_rental r on r.rental_id = p.rental_id join x_inventory i on i.inventory_id = r.inventory_id
             join x_film_category fc on fc.film_id = i.film_id
        where cast(p.payment_date as date) between date '{first}' and date '{last}' group by {by}"""
    add("distinct_over_months", with_roles(paid.format(by="i.store_id, fc.category_id", first="1996-03-01", last="1998-09-30")))
    add("distinct_by_store", with_roles(paid.format(by="i.store_id", first=FIRST_DAY, last=LAST_DAY)))
    spelt = lambda k, x: f"case when {k} % 3 = 0 then upper({x}) when {k} % 3 = 1 then lower({x}) || '  ' else {x} end"
    add("group_by_text", with_roles(f"""
        select min(x) first_name, count(*) n, sum(customer_id)::bigint ids
        from (select customer_id, {spelt("customer_id", "first_name")} x from x_customer) group by lower(rtrim(x))"""))
    add("join_by_text", with_roles(f"""
        select {spelt("film_id", "title")} title, film_id, min(film_id) over (partition by lower(rtrim(title))) first_film from x_film"""))
    folded = "(lower(rtrim(title)) <> lower(rtrim(new_title)) or lower(rtrim(description)) <> lower(rtrim(new_description)))"
    add("sync_film_text_collated", with_roles(SYNCED.format(changed=f"coalesce({folded}, false)").replace("from film_changes", "from spelt_changes"),
        film_changes=FILM_CHANGES, spelt_changes=f"select * replace ({spelt('film_id', 'new_title')} as new_title) from film_changes"))
    add("streamed_status", with_roles("""
        select inventory_id, film_id, store_id, is_in_stock, total_rentals, last_rental::varchar last_rental from now""", now=STATUS.format(rental="x_rental")))
    add("check_unique", "select l_orderkey, l_linenumber, count(*) n from lineitem group by all having count(*) > 1")
    add("check_unique_report", with_roles(_unique_keys(), **DERIVED))
    add("check_foreign_key", with_roles(_foreign_keys(), **DERIVED))
    add("check_domain", with_roles("""
        select 'audit_rental' table_name, 'action' column_name, false checked, null as value, null::bigint n
        union all select 'film', 'rating', true, rating, count(*) from x_film
        where rating not in ('G', 'PG', 'PG-13', 'R', 'NC-17') group by rating
        union all select 'film', 'release_year', true, release_year::varchar, count(*) from x_film
        where release_year < 1901 or release_year > 2155 group by release_year
        union all select 'audit_payment', 'action', true, 'update', count(*) from raised where last_update is not null having count(*) > 0""",
        raised=RAISED))
    add("check_required", with_roles(_required(ABSENT), **DERIVED))
    add("check_not_null", with_roles(" union all ".join(_nulls(table, columns) for table, columns in ROLE_COLUMNS.items())))
    kinds = {"LONG": "bigint", "STRING": "varchar", "INT": "integer", "TIMESTAMP_NTZ": "timestamp"}
    parts = []
    for table, columns in {**ROLE_COLUMNS, **DERIVED_COLUMNS}.items():
        for part in re.findall(r"([a-z_0-9]+) ([A-Z_]+(?:\(\d+,\d+\)|<[A-Z]+>)?)", DDL[table]):
            known = f"count(try_cast({part[0]} as {kinds.get(part[1], part[1])}))" if part[0] in columns.split() and part[0] != "last_update" else "0"
            known = "count(*)" if table in DERIVED_COLUMNS and part[0] == "last_update" else known
            parts.append(f"select '{table}' table_name, '{part[0]}' column_name, count(*) n, {known} n_known from x_{table}")
    add("load_tables", with_roles(" union all ".join(parts), **DERIVED))
    return sql
