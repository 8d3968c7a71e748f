import base64

from pyspark.sql import functions as F

from tracewright.operators import aggregates, detect_disk, detect_events, detect_web, filters, joins, topk, windows

SEC = "Security"
LOG = "host string, eid long, channel string, record_id long, us long, account string, source_ip string, logon_type string, payload string, service_name string, database string, new_pid long, parent_pid long, process_name string"


def log(spark, *events):
    base = dict(host="h", eid=0, channel=SEC, record_id=1, us=1, account="u", source_ip="1.2.3.4", logon_type="3", payload="", service_name="s", database="", new_pid=1, parent_pid=2, process_name="")
    return spark.createDataFrame([{**base, **e} for e in events], LOG)


def kinds(df, col="kind"):
    return sorted(r[col] for r in df.collect())


def test_log_clear_is_one_confirmed_lead_per_channel(spark):
    out = detect_events.log_cleared(log(spark, dict(eid=1102, record_id=4, us=9), dict(eid=1102, record_id=3, us=2), dict(eid=4624))).collect()
    assert [(r["confidence"], r["technique"], r["evidence"], r["occurrences"]) for r in out] == [("CONFIRMED", "T1070.001", "3", 2)]


def test_tasks_services_and_sessions(spark):
    df = log(
        spark, dict(eid=4698, payload="<Command>powershell.exe</Command><Arguments>-EncodedCommand SQBF</Arguments>"), dict(eid=4698, payload="defrag.exe -c"),
        dict(eid=7045, payload="C:\\Windows\\System32\\cmd.exe /c whoami"), dict(eid=7045, payload="C:\\Windows\\System32\\spoolsv.exe"),
        dict(eid=4624, logon_type="10"), dict(eid=4624, logon_type="3"), dict(eid=21, channel="Microsoft-Windows-TerminalServices-LocalSessionManager/Operational"), dict(eid=22, channel="Microsoft-Windows-TerminalServices-LocalSessionManager/Operational"), dict(eid=21, channel="System"),
    )
    assert detect_events.scheduled_tasks(df).count() == 1
    assert detect_events.service_installs(df).count() == 1
    assert kinds(detect_events.remote_desktop(df)) == ["rdp_logon", "rdp_session"]


def test_management_child_by_pid(spark):
    df = log(
        spark, dict(eid=4688, us=1, new_pid=0xAE8, parent_pid=0x248, process_name="C:\\Windows\\System32\\wbem\\WmiPrvSE.exe"), dict(eid=4688, us=2, new_pid=0xB10, parent_pid=0xAE8, process_name="C:\\Windows\\System32\\calc.exe"),
        dict(eid=4688, us=3, host="other", new_pid=5, parent_pid=0xAE8, process_name="x.exe"),
    )
    assert [r["subject"] for r in detect_events.management_children(df).collect()] == ["C:\\Windows\\System32\\calc.exe"]


def test_brute_force_and_directory_dump(spark):
    five = [dict(eid=4625, us=i) for i in range(5)]
    assert detect_events.failed_logon_bursts(log(spark, *five)).count() == 1
    assert detect_events.failed_logon_bursts(log(spark, *five[:4])).count() == 0
    df = log(spark, *[dict(eid=e, channel="Application", database="C:\\x\\ntds.dit") for e in (216, 325, 327)], dict(eid=325, channel="Application", database="Windows.edb"), dict(eid=325, database="ntds.dit"))
    assert detect_events.directory_dump(df).count() == 3


def test_legacy_logons_dedup(spark):
    out = detect_events.legacy_logons(log(spark, dict(eid=528), dict(eid=528, us=2), dict(eid=672), dict(eid=680), dict(eid=4768), dict(eid=7035)))
    assert kinds(out, "evidence") == ["4768", "528", "672", "680"]


REG = "host string, key_path string, value_name string, value_data string, value_type string, last_write_us long, row_no long"
RUN = "Software\\Microsoft\\Windows\\CurrentVersion\\Run"


def reg(spark, *entries):
    return spark.createDataFrame([("h", k, n, d, t, 5, i) for i, (k, n, d, t) in enumerate(entries)], REG)


def sz(key, name, data):
    return (key, name, data, "REG_SZ")


def test_autostarts(spark):
    out = detect_disk.autostarts(reg(
        spark, sz(RUN, "Updater", "C:\\Users\\mona\\AppData\\Roaming\\odd.exe"), sz(RUN, "Sync", '"C:\\Users\\x\\AppData\\Local\\Temp\\payload.exe" -silent'), sz(RUN, "SecurityHealth", "C:\\Windows\\System32\\SecurityHealthSystray.exe"),
        sz(RUN, "Host", "C:\\Windows\\System32\\svchost.exe"), sz(RUN, "SRFirstRun", "rundll32 srclient.dll"), sz(RUN, "cain", "C:\\Tools\\CAIN.EXE"),
        sz("ControlSet001\\Services\\OddSvc", "ImagePath", "C:\\Users\\mona\\AppData\\odd_svc.exe"), sz("ControlSet001\\Services\\Spooler", "ImagePath", "C:\\Windows\\System32\\spoolsv.exe"),
    ))
    assert sorted((r["kind"], r["subject"]) for r in out.collect()) == [("run_key", "Sync"), ("run_key", "Updater"), ("run_key", "cain"), ("service", "OddSvc")]


def test_port_proxy_usb_and_accounts(spark):
    usb = "ControlSet001\\Enum\\USBSTOR"
    names = "SAM\\Domains\\Account\\Users\\Names"
    df = reg(
        spark, sz("HKLM\\SYSTEM\\ControlSet001\\Services\\PortProxy\\v4tov4\\tcp", "0.0.0.0/8443", "127.0.0.1/3389"), sz("HKLM\\SYSTEM\\ControlSet001\\Services\\Foo", "x", "y"),
        sz(usb, "", ""), sz(usb + "\\Disk&Ven_Acme&Prod_Stick&Rev_1", "", ""), sz(usb + "\\Disk&Ven_Acme&Prod_Stick&Rev_1\\55AA01C7&0", "FriendlyName", "Acme Stick USB Device"),
        *[sz(names + "\\" + n, "", "") for n in ("evil fox", "Administrator", "Guest", "HelpAssistant", "SUPPORT_388945a0", "alice")], sz(names, "", ""),
    )
    assert [(r["listen"], r["connect"]) for r in detect_disk.port_proxies(df).collect()] == [("0.0.0.0/8443", "127.0.0.1/3389")]
    assert [(r["vendor"], r["product"], r["serial"]) for r in detect_disk.usb_devices(df).collect()] == [("Acme", "Stick", "55AA01C7&0")]
    assert [r["account"] for r in detect_disk.local_accounts(df).collect()] == ["evil fox"]


def test_recent_use(spark):
    wide = lambda s: (s.encode("utf-16-le") + b"\x00\x00\x14\x00\x1f\x80").hex()
    base = "Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\"
    save = base + "ComDlg32\\OpenSaveMRU\\exe"
    tool = "C:\\Documents and Settings\\J. Night\\Desktop\\ethereal-setup.exe"
    out = detect_disk.recent_use(reg(
        spark, sz("Software\\Microsoft\\Search Assistant\\ACMru\\5603", "000", "ethereal"), sz("Software\\Microsoft\\Search Assistant\\ACMru\\5603", "MRUList", "10"), sz("Software\\Microsoft\\Search Assistant\\ACMru\\5603", "001", ""),
        sz(save, "a", tool), sz(base + "ComDlg32\\OpenSaveMRU\\*", "a", tool), sz(save, "b", "C:\\Documents and Settings\\alice\\My Documents\\rota.xlsx"), sz(save, "c", "\\\\10.0.0.5\\share\\report.doc"), (save, "0", "6b006500", "REG_BINARY"),
        (base + "WordWheelQuery", "0", wide("netcat"), "REG_BINARY"), (base + "WordWheelQuery", "1", "zz", "REG_BINARY"), (base + "WordWheelQuery", "2", "0000", "REG_BINARY"), (base + "WordWheelQuery", "MRUListEx", "00000000", "REG_BINARY"),
        (base + "RecentDocs\\Folder", "0", wide("GhostWare"), "REG_BINARY"), (base + "RecentDocs", "1", wide("Bill.rtf"), "REG_BINARY"), (base + "RecentDocs\\NetHood", "2", wide("\\\\198.51.100.7\\Temp"), "REG_BINARY"),
        ("Software\\Microsoft\\Windows\\ShellNoRoam\\BagMRU\\2", "0", (b"\x14\x00\x1f\x00\x00mIRC\x00").hex(), "REG_BINARY"), ("Software\\Microsoft\\Windows\\ShellNoRoam\\BagMRU\\1", "0", (b"\x00\x00My Documents\x00").hex(), "REG_BINARY"),
        ("MountedDevices", "\\DosDevices\\F:", wide("_??_USBSTOR#Disk&Ven"), "REG_BINARY"), ("MountedDevices", "\\DosDevices\\C:", "f8a1b2c30000000000007e0000000000", "REG_BINARY"),
    ))
    got = sorted((r["kind"], r["value"].strip()) for r in out.collect())
    assert got == sorted([("search_term", "ethereal"), ("opened_file", tool), ("opened_file", "\\\\10.0.0.5\\share\\report.doc"), ("search_term", "netcat"), ("recent_doc", "GhostWare"), ("recent_doc", "\\\\198.51.100.7\\Temp"), ("shellbag", "mIRC"), ("mounted_device", "_??_USBSTOR#Disk&Ven")])


def test_capture_services_with_control_events(spark):
    svc = detect_disk.capture_services(reg(spark, sz("ControlSet001\\Services\\NPF", "ImagePath", "system32\\drivers\\npf.sys"), sz("ControlSet001\\Services\\Npfs", "ImagePath", ""), sz("ControlSet001\\Services\\Tcpip", "ImagePath", "system32\\drivers\\tcpip.sys")))
    assert [r["service_name"] for r in svc.collect()] == ["NPF"]
    events = log(spark, dict(eid=7036, service_name="DHCP Client"), dict(eid=7035, service_name="Workstation"), dict(eid=7035, host="other"))
    assert sorted(r["subject"] for r in detect_events.service_recon(events, svc).collect()) == ["DHCP Client", "Workstation"]


def files(spark, *paths):
    return spark.createDataFrame([("h", p, i, i) for i, p in enumerate(paths)], "host string, full_path string, si_created long, record_number long")


def test_tools_on_disk(spark):
    out = detect_disk.hacking_tools(files(spark, "Program Files/Anonymizer", "Documents and Settings/J. Night/Desktop/ethereal-setup-0.10.6.exe", "Program Files/Ethereal", "WINDOWS/Prefetch/ETHEREAL.EXE-1C148EEF.pf", "WINDOWS/system32/svchost.exe", "Program Files/Common Files/x.dll"))
    assert kinds(out, "tool") == ["anonymizer", "ethereal"]
    out = detect_disk.wipers_on_disk(files(spark, "Program Files/Eraser/Eraser.exe", "Program Files/Eraser/Eraser.Manager.dll", "Users/i/Desktop/Download/Eraser 6.2.exe", "Windows/Prefetch/CCLEANER64.EXE-779BD542.pf", "Windows/system32/svchost.exe"))
    assert sorted((r["tool"], r["presence"]) for r in out.collect()) == [("ccleaner", "prefetch_residue"), ("eraser", "installed")]


def prefetch(spark, *runs):
    return spark.createDataFrame([("h", n, c) for n, c in runs], "host string, executable_name string, run_count long")


def test_wiper_runs_and_encryption(spark):
    assert [(r["tool"], r["run_count"]) for r in detect_disk.wiper_runs(prefetch(spark, ("ERASER.EXE", 3), ("CCSETUP504.EXE", 0), ("SVCHOST.EXE", 9))).collect()] == [("eraser", 3)]
    out = detect_disk.encryption_tooling(prefetch(spark, ("GPG2.EXE", 1), ("KLEOPATRA.EXE", 2), ("VERACRYPT.EXE", 1), ("BDEUNLOCK.EXE", 1), ("BDEUISRV.EXE", 5), ("FVENOTIFY.EXE", 5), ("C:\\x\\gpg.exe", 1), ("CMD.EXE", 1)))
    assert sorted((r["family"], r["programs"], r["confidence"]) for r in out.collect()) == [("bitlocker", 1, "INFERRED"), ("container", 1, "INFERRED"), ("openpgp", 3, "INFERRED")]


def test_sync_channels(spark):
    disk = files(spark, "Program Files (x86)/Google/Drive/googledrivesync.exe", "Users/i/Google Drive/desktop.ini", "Windows/inf/megasas.inf", "Program Files/OneDrive/OneDrive.exe")
    visits = spark.createDataFrame([("h", "https://drive.google.com/drive/my-drive"), ("h", "https://mail.google.com/mail/u/0/#inbox"), ("h", "https://www.google.com/webhp?hl=en")], "host string, url string")
    out = detect_disk.sync_channels(disk, prefetch(spark, ("DROPBOX.EXE", 1)), visits).collect()
    assert sorted((r["service"], r["on_disk"], r["was_run"], r["visited"]) for r in out) == [("dropbox", False, True, False), ("google drive", True, False, True)]
    assert sorted((r["service"], r["kind"]) for r in detect_disk.cloud_visits(visits).collect()) == [("gmail", "webmail"), ("google drive", "cloud_storage")]


T0 = 1_427_204_991_000_000
MIN = 60_000_000


def journal(spark, *entries):
    return spark.createDataFrame([("h", n, f, T0 + t * MIN, e, i) for i, (n, f, t, e) in enumerate(entries)], "host string, filename string, reason_mask long, us long, mft_entry long, usn long")


C, D, OLD, NEW = joins.CREATED, joins.DELETED, joins.OLD_NAME, joins.NEW_NAME


def test_archive_staging(spark):
    staged = lambda *e: kinds(detect_disk.archive_staging(journal(spark, *e)), "filename")
    assert staged(("loot.zip", C, 0, 1), ("loot.zip", D, 18, 1)) == ["loot.zip"]
    assert staged(("loot.zip", D, 0, 1), ("loot.zip", C, 18, 1)) == []
    assert staged(("big.zip", C, 0, 1), ("big.zip", D, 60 * 24 * 400, 1)) == []
    assert staged(("Windows6.1-KB2888049-x64.cab", C, 0, 1), ("Windows6.1-KB2888049-x64.cab", D, 1, 1), ("WSUSSCAN.cab", C, 0, 2), ("WSUSSCAN.cab", D, 1, 2), ("E9292211.gz", C, 0, 3), ("E9292211.gz", D, 0, 3)) == []
    chain = journal(spark, ("secret_design.pptx", OLD, 0, 48389), ("winter_advisory.zip", NEW, 0, 48389), ("winter_advisory.zip", D, 18, 48389))
    assert kinds(detect_disk.archive_staging(chain), "filename") == ["winter_advisory.zip"]
    assert [r["renamed_from"] for r in joins.renamed_from(chain).collect()] == ["secret_design.pptx"]


def test_cleanup_after_staging(spark):
    out = detect_disk.cleanup_after_staging(journal(
        spark, ("loot.zip", C, 0, 1), ("proposal.docx", D, 2, 2), ("2015.xlsx", D, 3, 3), ("~$proposal.docx", D, 3, 4), ("__PSScriptPolicyTest_0gsy54vf.pe3.ps1", D, 3, 5), ("Config.Msi", D, 3, 6), ("c883.msi", D, 3, 7), ("loot.zip", D, 18, 1), ("unrelated.docx", D, -3000, 8), ("later.docx", D, 500, 9),
    ))
    assert kinds(out, "filename") == ["2015.xlsx", "proposal.docx"]
    assert detect_disk.cleanup_after_staging(journal(spark, ("proposal.docx", D, 2, 2))).count() == 0


def test_shortcuts_recycled_and_downloads(spark):
    links = spark.createDataFrame([("Recent\\staged-files.lnk", "Removable"), ("Recent\\calc.lnk", None), ("D\\NetHood\\staging share on fileserver\\target.lnk", None)], "source_file string, drive_type string")
    assert kinds(detect_disk.removable_shortcuts(links), "basis") == ["path_name", "volume"]
    items = spark.createDataFrame([("C:\\D\\Desktop\\ethereal-setup.exe",), ("C:\\D\\budget.doc",)], "filename string")
    assert kinds(detect_disk.recycled_tools(items), "tool") == ["ethereal"]
    history = spark.createDataFrame([("h", "Visited: J. Night@http://evil.example/warez/keygen.exe", 1), ("h", "http://evil.example/warez/keygen.exe", 2), ("h", "http://news.example/article.html", 3)], "host string, url string, us long")
    assert [(r["url"], r["hits"]) for r in detect_disk.illicit_downloads(history).collect()] == [("http://evil.example/warez/keygen.exe", 2)]


def test_region_hints(ev):
    code = "fce8000000005b" + "00" * 24
    hint = lambda image, mz=False, sample="48895c240857": ev(lambda a, b: filters.region_hint(a, F.lit(mz), b), image, sample)
    assert hint("MSMPENG.EXE") == "possible_av_emulation" and hint("w3wp.exe") == hint("dotnet.exe") == "possible_benign_jit_runtime"
    for args in (("w3wp.exe", True), ("w3wp.exe", False, code), ("powershell.exe",), ("rundll32.exe",), ("totally-unknown.exe",), ("",)):
        assert hint(*args) is None


def test_memory_leads(spark):
    ps = spark.createDataFrame([("h", 1, "chrome.exe"), ("h", 2, "KeePass.exe"), ("h", 3, "svchost.exe")], "host string, pid long, image_name string")
    out = detect_events.notable_applications(ps, ps.where("pid = 1")).collect()
    assert sorted((r["category"], r["technique"], r["in_list"], r["in_scan"]) for r in out) == [("browser", None, True, True), ("credential_store", "T1555", True, False)]
    lines = spark.createDataFrame([("h", 1, "cmd.exe", '"C:\\Windows\\system32\\cmd.exe" '), ("h", 2, "cmd.exe", '"C:\\Windows\\system32\\cmd.exe" /c whoami'), ("h", 3, "svchost.exe", "svchost.exe -k netsvcs"), ("h", 4, "cmd.exe", "Required memory at 0x0 is not valid")], "host string, pid long, image_name string, command_line string")
    history = spark.createDataFrame([("h", 5, "_COMMAND_HISTORY.CommandBucket_Command_0 CommandHistory", "net user hacker /add"), ("h", 6, "CommandHistory", "   "), ("h", 7, "_CONSOLE_INFORMATION.OriginalTitle", "cmd.exe")], "host string, pid long, property string, data string")
    assert sorted(r["pid"] for r in detect_events.recovered_commands(lines, history).collect()) == [2, 5]
    hidden = detect_events.hidden_processes(ps.where("pid <> 2"), ps)
    assert [(r["pid"], r["technique"]) for r in hidden.collect()] == [(2, "T1014")]


SIGN = "actor string, event_id long, us long, lat double, lon double, source_ip string"


def test_impossible_travel(spark):
    h = 3_600_000_000
    df = spark.createDataFrame([("u", 1, 0, 40.71, -74.01, "1.2.3.4"), ("u", 2, h // 2, -33.87, 151.21, "5.6.7.8"), ("v", 3, 0, 40.71, -74.01, "a"), ("v", 4, 5 * h, 42.36, -71.06, "b"), ("w", 5, 0, 40.71, -74.01, "c"), ("x", 6, 1, -33.87, 151.21, "d"), ("y", 7, 0, None, None, "e")], SIGN)
    assert [(r["actor"], r["from_ip"], r["to_ip"]) for r in windows.impossible_travel(df).collect()] == [("u", "1.2.3.4", "5.6.7.8")]


def test_prompt_bombing(spark):
    s = 1_000_000
    accepted = [("victim", i, i * 40 * s, "500121") for i in range(5)] + [("victim", 9, 200 * s, "0")]
    refused = [("refuser", i, i * 30 * s, "500121") for i in range(5)]
    slow = [("slow", i, i * 3600 * s, "500121") for i in range(6)]
    spread = [(f"u{i}", i, i * s, "500121") for i in range(5)]
    few = [("few", i, i * s, "500121") for i in range(2)] + [("ok", 1, 1, "0")]
    df = spark.createDataFrame(accepted + refused + slow + spread + few, "actor string, event_id long, us long, outcome string")
    assert sorted((r["actor"], r["prompt_count"], r["accepted_after_denials"]) for r in detect_web.fatigue_leads(df).collect()) == [("refuser", 5, False), ("victim", 5, True)]


def test_consents_and_forwarding(spark):
    consent = lambda scope: '{"additionalDetails":[{"key":"Scope","value":"%s"}]}' % scope
    df = spark.createDataFrame([("a@c.com", "Consent to application", consent("Mail.Read offline_access")), ("b@c.com", "Consent to application", consent("openid profile email")), ("c@c.com", "Sign-in activity", "{}")], "actor string, action string, raw string")
    assert kinds(detect_web.illicit_consents(df), "actor") == ["a@c.com"]
    rule = lambda n, v: '{"Parameters":[{"Name":"%s","Value":"%s"}]}' % (n, v)
    df = spark.createDataFrame([("v@contoso.com", "New-InboxRule", rule("ForwardTo", "attacker@gmail.com")), ("w@contoso.com", "Set-Mailbox", rule("ForwardingSmtpAddress", "smtp:exfil@proton.me")), ("x@contoso.com", "New-InboxRule", rule("ForwardTo", "mate@contoso.com")), ("y@contoso.com", "MailItemsAccessed", "{}")], "actor string, action string, raw string")
    assert kinds(detect_web.forwarding_rules(df), "external_target") == ["attacker@gmail.com", "exfil@proton.me"]
    assert kinds(detect_web.forwarding_rules(df, ["contoso.com", "gmail.com"]), "external_target") == ["exfil@proton.me"]


MAIL = "case_id string, msg_id long, us long, from_address string, from_display string, reply_to_address string, to_address string, subject string, attachment string, date string"


def mail(spark, *msgs):
    base = dict(case_id="c", from_address="staff@corp.example", from_display="", reply_to_address="", to_address="cfo@corp.example", subject="hello", attachment="", date="Tue, 15 Jul 2008 09:12:44 -0700")
    return spark.createDataFrame([{**base, "msg_id": i, "us": i, **m} for i, m in enumerate(msgs)], MAIL)


def inside(spark):
    return spark.createDataFrame([("c", "corp.example")], "case_id string, domain string")


def test_mail_divergence_and_impersonation(spark):
    out = detect_web.reply_divergence(mail(
        spark, dict(reply_to_address="boss@mailhost.example"), dict(from_address="n@n.example.org", reply_to_address="r@example.org"), dict(from_address="Staff@Corp.Example", reply_to_address=" staff@corp.example "), dict(),
        dict(from_display="boss@corp.example", from_address="o@mailhost.example"), dict(from_display="Pat Morgan", from_address="o@mailhost.example"),
    ))
    assert kinds(out, "basis") == ["reply_to_vs_from", "sender_display_vs_from"]
    out = detect_web.impersonation(mail(
        spark, dict(from_display="Pat Morgan"), dict(from_display="Pat Morgan", from_address="pat@mailhost.example"), dict(reply_to_address="pat@mailhost.example"), dict(from_display="Newsletter", from_address="news@mailhost.example"),
        dict(from_display="boss@corp.example", from_address="o@mailhost.example"), dict(from_display="news@mailhost.example", from_address="news@mailhost.example"),
    ), inside(spark))
    assert sorted((r["msg_id"], r["basis"]) for r in out.collect()) == [(1, "internal_display_name_external_sender"), (2, "internal_sender_external_reply_to"), (4, "internal_display_address_external_sender")]
    assert [r["domain"] for r in aggregates.internal_domains(mail(spark, dict(), dict(from_address="x@mailhost.example")).withColumn("to", F.array("to_address"))).collect()] == ["corp.example"]


def test_spreadsheets(spark):
    sent = dict(from_address="cfo@corp.example", to_address="o@mailhost.example", attachment="staff-roster.xls")
    out = detect_web.spreadsheet_egress(mail(spark, sent, {**sent, "to_address": "hr@corp.example"}, {**sent, "attachment": "logo.png"}, {**sent, "from_address": "o@mailhost.example", "to_address": "cfo@corp.example"}), inside(spark))
    assert [r["msg_id"] for r in out.collect()] == [0]
    lure = dict(subject="urgent request", from_display="boss@corp.example", from_address="o@mailhost.example")
    answer = dict(subject="RE: urgent request", from_address="cfo@corp.example", to_address="boss@corp.example", attachment="staff-roster.xls")
    out = joins.reply_to_spoof(mail(spark, lure, answer, {**answer, "subject": "quarterly numbers"}, {**answer, "attachment": ""}))
    assert [(r["msg_id"], r["displayed"], r["first_sender"]) for r in out.collect()] == [(1, "boss@corp.example", "o@mailhost.example")]


def test_mail_escalation(spark):
    lure = dict(subject="urgent request", from_display="boss@corp.example", from_address="o@mailhost.example", date="Sat, 19 Jul 2008 18:22:45 -0700 (PDT)")
    answer = dict(subject="RE: urgent request", from_address="cfo@corp.example", to_address="boss@corp.example", attachment="roster.xls", date="Jul 20, 2008 01:28:47.828125000 UTC")
    read = lambda *m: detect_web.mail_escalation(detect_web.mail_exchanges(mail(spark, *m), inside(spark))).collect()
    (row,) = read(lure, answer, {**answer, "subject": "quarterly numbers"})
    assert (row["counterparty"], row["message_count"], row["inbound_count"], row["outbound_count"], row["diverging_count"], row["outbound_attachments"]) == ("o@mailhost.example", 2, 1, 1, 1, 1)
    assert row["first_us"] < row["last_us"]
    (row,) = read({**lure, "date": "whenever"}, answer)
    assert row["first_us"] is None and row["last_us"] is None
    assert read(lure) == [] and read(*[dict(from_address="news@mailhost.example", subject=str(i)) for i in range(20)]) == [] and read(*[dict(subject=s) for s in "abc"]) == []


def test_network_leads(spark):
    pk = b"PK\x03\x04" + b"\x00" * 22 + b"\x14\x00\x00\x00" + b"mnt/Admin_share/a.xl" + b"\x00" * 20
    hosts = ["youtube.com", "www.google.com", "www.yahoo.com", "www.myspace.com", "en.wikipedia.org"]
    req = spark.createDataFrame([("relay", h, "GET") for h in hosts] + [("cdn", f"{x}.travelocity.com", "GET") for x in "abcdef"], "dst string, host string, method string")
    cookies = spark.createDataFrame([("relay", base64.b64encode(pk).decode()), ("cdn", base64.b64encode(pk).decode()), ("relay", "CA1344E4C4D800FC")], "dst string, value string")
    assert [r["dst"] for r in aggregates.multiplexed(req).collect()] == ["relay"]
    out = detect_web.covert_cookies(cookies, req).collect()
    assert [(r["dst"], r["container"], r["from_admin_share"], r["confidence"]) for r in out] == [("relay", "zip", True, "CONFIRMED")]
    anon = spark.createDataFrame([("www.willselfdestruct.com", "POST"), ("www.willselfdestruct.com", "GET"), ("willselfdestruct.com.evil.example", "POST"), ("news.example", "POST")], "host string, method string")
    assert kinds(detect_web.anonymous_mail(anon), "confidence") == ["CONFIRMED", "HYPOTHESIS"]


def test_webshell_formula(spark):
    lines = spark.createDataFrame([("/var/www/uploads/s.php", "system($_GET[1]);"), ("/app/lib.php", "exec($cmd);"), ("/app/x.php", "eval($a);"), ("/app/x.php", "base64_decode($b);"), ("/app/i.php", "echo 1;")], "path string, line string")
    assert sorted((r["path"], r["writable_location"]) for r in detect_web.webshells(lines).collect()) == [("/app/x.php", False), ("/var/www/uploads/s.php", True)]


def test_shared_root_runs_need_a_second_class(spark):
    entries = spark.createDataFrame([("h", 1, "C:\\Users\\Public\\a.exe", 10), ("h", 2, "C:\\Users\\Public\\b.exe", 10), ("h", 3, "C:\\Program Files\\c.exe", 10), ("h", 4, "D:\\Temp\\d.exe", 10)], "host string, entry_id long, program_path string, last_run_us long").withColumn("encoded_name", F.lit(""))
    mft = spark.createDataFrame([("h", "C", "Users/Public/a.exe", True, 5, 1), ("h", "C", "Temp/d.exe", True, 5, 2), ("h", "C", "Users/Public/b.exe", False, 5, 3)], "host string, volume string, full_path string, is_allocated boolean, si_modified long, record_number long")
    out = detect_disk.shared_root_runs(entries, mft, prefetch(spark, ("D.EXE", 0))).collect()
    assert sorted((r["entry_id"], r["confidence"]) for r in out) == [(1, "CONFIRMED"), (2, "HYPOTHESIS"), (4, "HYPOTHESIS")]


def test_filters_errors_and_nulls(spark):
    import pytest

    df = spark.createDataFrame([(1, None, 0x100), (2, 5, 0x200), (3, 50, 0x102)], "id long, us long, reason_mask long")
    assert [r["id"] for r in filters.file_time_filter(df, F.lit(1), F.lit(5), "us").collect()] == [1, 2]
    assert sorted(r["id"] for r in filters.journal_filter(df, reasons=["file_create"]).collect()) == [1, 3]
    with pytest.raises(ValueError):
        filters.journal_filter(df, reasons=["NOPE"])
    with pytest.raises(ValueError):
        filters.min_level(df, "severe")
    k8s = spark.createDataFrame([('{"sourceIPs":["1.1.1.1"],"user":{"username":"u"},"responseStatus":{"code":403},"verb":true}',)], "raw string")
    row = filters.cloud_envelope(k8s, "k8s_audit").first()
    assert (row["source_ip"], row["actor"], row["outcome"], row["action"]) == ("1.1.1.1", "u", "403", None)
    assert filters.cloud_envelope(k8s, "other").first()["actor"] is None


def test_round_robin_and_capped(spark):
    rows = [(0, p, 0, i, f"{p}{i}") for p in (0, 1) for i in range(3)] + [(1, 0, 0, 0, "z")]
    df = spark.createDataFrame(rows, "tier long, class_priority long, sub_rank long, partition_rank long, path string")
    assert [r["path"] for r in topk.round_robin(df, 4).collect()] == ["00", "10", "01", "11"]
    out = topk.capped(df.select("path"), ["path"], 2).collect()
    assert [(r["path"], r["total"], r["truncated"]) for r in out] == [("00", 7, True), ("01", 7, True)]
    order = topk.triage_order(spark.createDataFrame([("All Users/Start Menu/Programs/Calculator.lnk",), ("Suspect/NetHood/staging share/target.lnk",)], "path string"))
    assert "NetHood" in order.first()["path"]
    logs = topk.triage_order(spark.createDataFrame([(p,) for p in ("a/Microsoft-Windows-X.evtx", "a/Application.evtx", "a/Security.evtx", "a/Sysmon%4Operational.evtx")], "path string"))
    assert [r["rank"] for r in logs.collect()] == [0, 0, 1, 2]


def test_actions_come_from_the_callers_table(spark):
    judged = spark.createDataFrame(
        [("c", t, "supported", o, False) for t, o in (("t1070.001", "SUSPICIOUS"), ("T1070.002", "suspicious"), ("T1099", "SUSPICIOUS"), ("T1070.001", "INDETERMINATE"))] + [("c", "T1070", "contradicted", None, False), ("c", None, "supported", "SUSPICIOUS", True)],
        "case_id string, technique_id string, status string, outcome string, possible_hallucination boolean",
    )
    table = spark.createDataFrame([("T1070", "keep a copy"), ("t1070.001", "ask the log host"), ("T1070.001", "later by text"), (None, "never")], "technique_id string, action string")
    out = joins.derive_actions(judged, table, default="none known").collect()
    assert len(out) == 6
    assert sorted((r["technique_id"], r["action"]) for r in out if r["route"] == "act") == [("T1070.001", "ask the log host"), ("T1070.002", "keep a copy"), ("T1099", "none known")]
    assert sorted(r["action"] for r in joins.derive_actions(judged, table.limit(0), default="none known").collect() if r["route"] == "act") == ["none known"] * 3
