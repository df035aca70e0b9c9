import pytest
from pyspark.sql import functions as F

from riskloom.functions import paths as px
from riskloom.operators import deadfiles
from riskloom.operators.scan import custom_files


def reasons(df):
    return {(r.file, r.rule, r.severity, r.match) for r in df.collect()}


def test_first_reason(listing):
    tree = listing(
        "a/Backup.php", "phpinfo.php", "demo-abcdefghij-k.php", "_x.php", "x---y.php", "latest.php",
        "dashboard.php", "b/x.bak.php", "old.php", "f-old.php", "vendor/test.php", "notes-old.txt",
    )
    got = {r.file: r.match for r in deadfiles.scan_names(tree, "line", "CRITICAL").collect()}
    assert got == {
        "a/Backup.php": "suspicious substring 'backup' in filename: Backup.php",
        "phpinfo.php": "known dangerous filename: phpinfo.php",
        "demo-abcdefghij-k.php": "demo file pattern: demo-abcdefghij-k.php",
        "_x.php": "special prefix in filename: _x.php",
        "x---y.php": "special prefix in filename: x---y.php",
        "latest.php": "suspicious substring 'test' in filename: latest.php",
        "b/x.bak.php": "suspicious substring 'bak' in filename: x.bak.php",
        "f-old.php": "suspicious substring '-old' in filename: f-old.php",
    }


def test_all_reasons(listing):
    tree = listing("_old123.txt", "demo-abcdefgh-x.php", "dashboard.php", "s/wp-config.php", ".vendor/old.php")
    got = {(r.file, r.line, r.match) for r in deadfiles.scan_names(tree, "span").collect()}
    assert got == {
        ("_old123.txt", 1, "suspicious_prefix;backup_or_temp;suspicious_suffix"),
        ("demo-abcdefgh-x.php", 1, "demo_pattern"),
        ("s/wp-config.php", 1, "wp_config_outside_wordpress"),
    }
    assert deadfiles.scan_names(tree, "span", "HIGH").collect() == []
    root = listing("s/wp-config.php", "wp-admin/x.php")
    assert deadfiles.scan_names(root, "span").collect() == []


def test_multi_rule(listing):
    tree = listing(
        "device.bcakup.php", "demo-abc123xyz-k.php", "demo-abcdefghij.php", "_copy.php", "dashboard.php",
        "a/wp-config.php", "b/wp-config.php", "b/wp-includes/x.php", "wp-config.php", "F.PHP",
    )
    got = {(r.file, r.rule, r.severity) for r in deadfiles.scan_names(tree, "block").collect()}
    assert got == {
        ("device.bcakup.php", "deadfile_backup_extension", "INFO"),
        ("demo-abc123xyz-k.php", "deadfile_backup_in_name", "LOW"),
        ("demo-abcdefghij.php", "deadfile_dangerous_demo", "HIGH"),
        ("_copy.php", "deadfile_backup_in_name", "LOW"),
        ("_copy.php", "deadfile_special_prefix", "MEDIUM"),
        ("a/wp-config.php", "deadfile_misplaced_wp_config", "CRITICAL"),
        ("wp-config.php", "deadfile_misplaced_wp_config", "CRITICAL"),
    }
    high = deadfiles.scan_names(tree, "block", "HIGH").collect()
    assert {r.severity for r in high} == {"HIGH", "CRITICAL"}


@pytest.mark.parametrize(
    ("profile", "kept"),
    [
        ("line", {"app/vendor/a.php", ".vendor/a.php", "vendored/a.php", "A.PHP", "x/mailer/vendor/a.php"}),
        ("span", {"app/vendor/a.php", "vendored/a.php", "A.PHP", "x/mailer/vendor/a.php"}),
        # Two-part entries never equal one component, so classes/mailer stays.
        ("block", {".vendor/a.php", "vendored/a.php", "classes/mailer/a.php", "test/PHPExcel/a.php"}),
    ],
)
def test_vendor_rules(listing, profile, kept):
    tree = listing(
        "vendor/a.php", "app/vendor/a.php", ".vendor/a.php", "vendored/a.php", "mailer/vendor/a.php",
        "x/mailer/vendor/a.php", "classes/mailer/a.php", "test/PHPExcel/a.php", "A.PHP", "a.txt",
    )
    assert {r.path for r in custom_files(tree, profile).collect()} == kept


def test_outside_root(listing):
    tree = listing("/srv/app/x.php", "/srv/app/vendor/x.php", "/other/x.php", "/vendor/x.php")
    kept = {
        p: {r.path for r in tree.filter(px.is_custom(F.col("path"), p, "/srv/app")).collect()}
        for p in ("line", "span", "block")
    }
    assert kept["line"] == kept["block"] == {"/srv/app/x.php"}
    assert kept["span"] == {"/srv/app/x.php", "/other/x.php"}
