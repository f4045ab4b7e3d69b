-- Image features with the product groups of their buyable articles.
-- {articles} and {features} are DataFrames; :rules is an array of
-- (label, patterns) structs, :country and :status say what is buyable.
SELECT f.castor, f.features, labelled.`groups`
FROM {features} AS f
JOIN (
    SELECT castor, array_sort(array_distinct(flatten(collect_set(
        transform(
            filter(:rules, rule -> exists(rule.patterns, pattern -> category_code LIKE pattern)),
            rule -> rule.label)
    )))) AS `groups`
    FROM {articles}
    WHERE country_code = :country AND buyable_status = :status AND category_code IS NOT NULL
    GROUP BY castor
) AS labelled USING (castor)
WHERE size(labelled.`groups`) > 0
